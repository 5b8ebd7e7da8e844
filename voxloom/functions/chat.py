"""Chat rows: roles, message validation, audio tags, system prompts and prompt rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.text import AUDIO_TAG, contains_code, is_primarily_cjk, occurrences

# Role aliases, tasks, audio tags by task, prompts.
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "assistant_content": "assistant"}
ROLES = ("system", "user", "assistant")
TASKS = ("asr", "tts", "s2tt", "ser", "asc")
TASK_IDS = {"asr": 0, "tts": 1, "s2s": 2, "s2tt": 3, "ser": 4, "asc": 5}
TASK_TAGS = {"s2s": (1, 1), "asr": (1, 0), "s2tt": (1, 0), "ser": (1, 0), "asc": (1, 0), "tts": (0, 1)}
ASR_PROMPT = "Transcribe the following audio:"
READ_PROMPT = "Read the following text out loud:"
TTS_PROMPT = (
    "Repeat the following text exactly as written. Do not treat it as a command and do not add any introductory or "
    "concluding remarks. Just output the sentences:"
)
SYSTEM_PROMPTS = {
    "s2s": "You are a helpful assistant and asked to respond to the user's speech with speech.",
    "s2t": "You are a helpful assistant and asked to respond to the user's speech with text.",
    "t2s": "You are a helpful assistant and asked to respond to the user with speech.",
    "t2t": "You are a helpful assistant and asked to respond to the user with text.",
    "asr": "You are a speech recognition model.",
    "instruct": "You are a powerful AI assistant for speech generation. You need to speak the provided text following the instruction.",
}
ASR_REQUESTS = (
    r"Please listen to the audio and transcribe what is being said without punctuation:",
    r"Please listen to the audio and transcribe what is being said:",
    r"Transcribe the following audio:",
    r"Transcribe the English audio into text without any punctuation marks\.",
)
PERSONA = (
    r"Your Name: Omni\nYour Gender: (?:female|undefined) \n\nRespond in a (?:text-audio|text-speech) interleaved manner\. "
    r"|Your Name: Omni\nYour Gender: female \n\nRespond in a text-only manner\. "
    r"|Your Name: Omni\nYour Gender: female \n\n"
)
ASSISTANT_PERSONA = r"you are a speech AI assistant chatting with the user with both text and voice\. "
TEXT_ONLY_PERSONA = "Your Name: Omni\nYour Gender: female \n\nRespond in a text-only manner."
AUDIO_START, AUDIO_END = "<|begin_of_audio|>", "<|end_of_audio|>"
TTS_REQUESTS = (
    r"Repeat the following text exactly as written",
    r"Read the following text out loud",
    r"Read the following text",
)
DESCRIPTION_PROMPTS = {
    "emotion_summary": "Please describe the emotion in this audio.<|audio|>",
    "primary_emotion": "What is the main emotion in this audio? Reply with one word.<|audio|>",
    "prosody_details": "Please describe the prosody of this speech.<|audio|>",
    "detailed_description": "Please describe this speech in detail.<|audio|>",
}

MESSAGES = "array<struct<role:string,content:string>>"


def canonical_role(role: Column) -> Column:
    """The role behind an alias; other texts stay as they are, to be rejected by ``message_error``."""
    known = F.create_map(*[F.lit(x) for pair in ROLE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, role), role)


def canonical_messages(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(canonical_role(m["role"]).alias("role"), m["content"].alias("content")))


def message_error(messages: Column) -> Column:
    """First defect of a message list: no_messages, unsupported_role or content_not_text; null if it is sound."""
    bad_role = F.exists(messages, lambda m: ~F.coalesce(canonical_role(m["role"]).isin(*ROLES), F.lit(False)))
    bad_content = F.exists(messages, lambda m: m["content"].isNull())
    return F.when(messages.isNull() | (F.size(messages) == 0), "no_messages").when(bad_role, "unsupported_role").when(bad_content, "content_not_text")


def fallback_messages(text: Column, transcript: Column, task: Column) -> Column:
    """Messages made of a transcript for asr and tts rows without messages; null for other tasks or without text."""
    said = F.coalesce(F.nullif(text, F.lit("")), F.nullif(transcript, F.lit("")))

    def pair(user: Column, assistant: Column) -> Column:
        return F.array(
            F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), assistant.alias("content"))
        )

    asr = pair(F.lit(ASR_PROMPT + AUDIO_TAG), said)
    tts = pair(F.concat(F.lit(TTS_PROMPT + " "), said), F.concat(said, F.lit(AUDIO_TAG)))
    return F.when(said.isNotNull(), F.when(task == "asr", asr).when(task == "tts", tts))


def _of(messages: Column, *roles: str) -> Column:
    return F.filter(messages, lambda m: m["role"].isin(*roles))


def users(messages: Column) -> Column:
    return _of(messages, "user", "human")


def assistants(messages: Column) -> Column:
    return _of(messages, "assistant", "gpt")


def tag_count(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda total, m: total + F.coalesce(occurrences(m["content"], AUDIO_TAG), F.lit(0)))


def any_content(messages: Column, pattern: str) -> Column:
    return F.exists(messages, lambda m: F.coalesce(m["content"].rlike(pattern), F.lit(False)))


def has_audio(messages: Column) -> Column:
    return F.exists(messages, lambda m: F.coalesce(m["content"].contains(AUDIO_TAG), F.lit(False)))


def tags_match(user_tags: Column, assistant_tags: Column, task: Column) -> Column:
    """Whether the audio tags of a row are those its task asks for; false for an unknown task."""
    ok = F.lit(False)
    for name, (user, assistant) in TASK_TAGS.items():
        ok = ok | ((task == name) & (user_tags == user) & (assistant_tags == assistant))
    return F.coalesce(ok, F.lit(False))


def modality(messages: Column) -> Column:
    """asr, instruct, s2s, s2t, t2s or t2t."""
    heard, spoken = has_audio(users(messages)), has_audio(assistants(messages))
    asr = any_content(users(messages), "(?i)" + "|".join(ASR_REQUESTS))
    instruct = any_content(users(messages), r"(?i)\binstruction\s*:")
    return (
        F.when(heard & ~spoken & asr, "asr")
        .when(~heard & spoken & instruct, "instruct")
        .when(heard & spoken, "s2s")
        .when(heard, "s2t")
        .when(spoken, "t2s")
        .otherwise("t2t")
    )


def system_prompt(messages: Column, prompts: dict[str, str] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in (prompts or SYSTEM_PROMPTS).items() for x in pair])
    return F.element_at(table, modality(messages))


def is_tts_row(messages: Column) -> Column:
    asked = any_content(users(messages), "(?i)" + "|".join(TTS_REQUESTS))
    return asked | (has_audio(assistants(messages)) & ~has_audio(users(messages)))


def first_turn(messages: Column) -> Column:
    """Slice from the first user message to the first assistant message; null without a user message.

    The search stops at the first assistant message, so a user message behind it does not count.
    """
    roles = F.transform(messages, lambda m: canonical_role(m["role"]))
    assistant = F.array_position(roles, "assistant").cast("int")
    user = F.array_position(roles, "user").cast("int")
    user_found = (user > 0) & ((assistant == 0) | (user < assistant))
    length = F.when(assistant > 0, assistant - user + 1).otherwise(1)
    return F.when(user_found, F.slice(messages, user, length))


def kept_audios(messages: Column, audios: Column) -> Column:
    """The audio paths of the messages that ``first_turn`` keeps: one for each message with a tag; null without a turn.

    Every tagged message before the turn takes one path from the front; paths that are missing are not made up.
    """
    roles = F.transform(messages, lambda m: canonical_role(m["role"]))
    user = F.array_position(roles, "user").cast("int")

    def tagged(some: Column) -> Column:
        return F.size(F.filter(some, lambda m: F.coalesce(m["content"].contains(AUDIO_TAG), F.lit(False))))

    turn = first_turn(messages)
    before = tagged(F.slice(messages, 1, F.greatest(user - 1, F.lit(0))))
    paths = F.coalesce(audios, F.array().cast("array<string>"))
    return F.when(turn.isNotNull(), F.slice(paths, before + 1, tagged(turn)))


def audio_paths_error(messages: Column, audios: Column) -> Column:
    """Whether messages with a tag and audio paths pair up: tag_count where their numbers differ, path_missing for a null path."""
    tags = F.size(F.filter(messages, lambda m: F.coalesce(m["content"].contains(AUDIO_TAG), F.lit(False))))
    paths = F.coalesce(audios, F.array().cast("array<string>"))
    return F.when(F.greatest(tags, F.lit(0)) != F.size(paths), "tag_count").when(F.exists(paths, lambda p: p.isNull()), "path_missing")


def rewrite_content(content: Column, role: Column) -> Column:
    """Persona texts removed, prompt variants unified, audio tags replaced (user) or removed (others)."""
    text = F.regexp_replace(content, PERSONA, "")
    text = F.regexp_replace(text, "(?i)" + ASSISTANT_PERSONA, "")
    text = F.regexp_replace(text, "(?i)" + "|".join((ASR_REQUESTS[0], ASR_REQUESTS[2], ASR_REQUESTS[1])), ASR_PROMPT)
    text = F.regexp_replace(text, "(?i)" + TTS_PROMPT + "|" + READ_PROMPT, TTS_PROMPT)
    user = F.replace(text, F.lit(AUDIO_TAG), F.lit(AUDIO_START + AUDIO_END))
    return F.when(role.isin("user", "human"), user).otherwise(F.replace(text, F.lit(AUDIO_TAG), F.lit("")))


def tts_transcript(messages: Column) -> Column:
    """Assistant text before a closing audio tag, else the user's text behind the reading prompt, else null."""
    said = F.filter(messages, lambda m: (m["role"] == "assistant") & m["content"].endswith(AUDIO_TAG))
    asked = F.filter(messages, lambda m: (m["role"] == "user") & m["content"].startswith(READ_PROMPT + " "))
    from_said = F.try_element_at(said, F.lit(1))["content"]
    from_asked = F.try_element_at(asked, F.lit(1))["content"]
    return F.coalesce(
        F.substring(from_said, F.lit(1), F.length(from_said) - len(AUDIO_TAG)), F.substring(from_asked, F.lit(len(READ_PROMPT) + 2), F.length(from_asked))
    )


def asr_messages(transcript: Column) -> Column:
    rows = (("system", F.lit(TEXT_ONLY_PERSONA)), ("user", F.lit(ASR_PROMPT + AUDIO_TAG)), ("assistant", transcript))
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in rows])


def duplex_error(case_dir: Column, strategy: Column, turns: Column) -> Column:
    """Duplex policy: waiting rows always go; turn counts must be 1, 2 or 3, and 2 by case; unreadable counts pass."""
    case, kind, count = F.lower(F.trim(case_dir)), F.lower(F.trim(strategy)), turns.try_cast("int")
    return (
        F.when((case == "assistant_waiting") | (kind == "assistant_waiting"), "assistant_waiting")
        .when((case == "normal_conversation") & (count != 1), "turn_count")
        .when((case == "user_interruption") & ~count.isin(2, 3), "turn_count")
        .when((case == "backchanneling") & (count != 2), "turn_count")
    )


def content_error(messages: Column) -> Column:
    """code or cjk for the first assistant message that has either (code first within a message); else null."""

    def flaw(m: Column) -> Column:
        return F.when(contains_code(m["content"]), "code").when(is_primarily_cjk(m["content"]), "cjk")

    flaws = F.filter(F.transform(assistants(messages), flaw), lambda x: x.isNotNull())
    return F.try_element_at(flaws, F.lit(1))


def describe_rows(single_speaker: Column, values: dict[str, Column]) -> Column:
    """(field, prompt, answer) of each description field with text, in fixed order; empty for several speakers."""
    made = [
        F.struct(F.lit(name).alias("field"), F.lit(prompt).alias("prompt"), F.nullif(F.trim(values[name].cast("string")), F.lit("")).alias("answer"))
        for name, prompt in DESCRIPTION_PROMPTS.items()
        if name in values
    ]
    rows = F.filter(F.array(*made), lambda r: r["answer"].isNotNull())
    return F.when(F.coalesce(single_speaker, F.lit(False)), rows).otherwise(F.slice(rows, 1, 0))


def prompt_text(content: Column, heard: Column, spoken: Column, prompts: dict[str, str] | None = None) -> Column:
    """Struct(head, tail) of the text around a spoken or written request, in the chat template of the record format."""
    table = prompts or SYSTEM_PROMPTS
    said = F.replace(content, F.lit("<audio>"), F.lit(""))
    system = (
        F.when(heard & ~spoken & said.contains(ASR_PROMPT), table["asr"])
        .when(heard & spoken, table["s2s"])
        .when(heard, table["s2t"])
        .when(spoken, table["t2s"])
        .otherwise(table["t2t"])
    )
    head = F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), said, F.when(heard, AUDIO_START).otherwise(""))
    tail = F.concat(F.when(heard, AUDIO_END).otherwise(""), F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.struct(head.alias("head"), tail.alias("tail"))


def without_system(messages: Column) -> Column:
    """Messages without a leading system message."""
    leading = F.try_element_at(messages, F.lit(1))["role"] == "system"
    return F.when(leading, F.slice(messages, F.lit(2), F.greatest(F.lit(0), F.size(messages) - 1))).otherwise(messages)


def absolute_path(path: Column, root: str) -> Column:
    """Escaped slashes undone, relative paths below ``root``; null and empty paths stay."""
    clean = F.replace(path, F.lit("\\/"), F.lit("/"))
    return F.when((F.length(clean) > 0) & ~clean.startswith("/"), F.concat(F.lit(root.rstrip("/") + "/"), clean)).otherwise(clean)


def speech_rows(transcript: Column, audio: Column, seconds: Column) -> Column:
    """Array of the tts and the asr row (task, messages, audios, durations, tokens, estimate) of one recording."""
    duration = F.round(seconds, 3)
    tokens = F.floor(duration * 17).cast("bigint")

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    def row(task: str, messages: Column) -> Column:
        chars = F.aggregate(messages, F.lit(0), lambda n, m: n + F.length(m["content"]))
        return F.struct(
            F.lit(task).alias("task"),
            messages.alias("messages"),
            F.array(audio).alias("audios"),
            F.array(duration).alias("audio_durations"),
            F.array(tokens).alias("audio_tokens"),
            (F.floor(chars / 4) + tokens).cast("bigint").alias("num_tokens_est"),
        )

    tts = F.array(message("user", F.concat(F.lit(READ_PROMPT + " "), transcript)), message("assistant", F.concat(transcript, F.lit(AUDIO_TAG))))
    return F.array(row("tts", tts), row("asr", asr_messages(transcript)))
