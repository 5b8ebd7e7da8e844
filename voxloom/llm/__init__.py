"""voxloom.llm"""
