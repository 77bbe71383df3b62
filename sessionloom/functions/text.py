"""Text, id and number expressions. Each takes columns and gives a column; nulls count as empty text unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, the no-break kinds included.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Characters that count as one token.
CHARS_PER_TOKEN = 4
# The roles and model families of the event table.
ROLES = ("system", "developer", "user", "assistant", "tool", "observer")
FAMILIES = ("openai", "anthropic", "google", "unknown")
EVENT_TYPES = ("metadata", "context", "message", "reasoning", "tool_call", "tool_result", "compaction", "usage", "agent_event")


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def compact_text(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text_of(c), f"{SPACE}+", " "))


def preview(c: Column, most: int = 240) -> Column:
    """Compacted text of at most so many characters, an ellipsis included."""
    t = compact_text(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def preview_raw(c: Column, most: int = 240) -> Column:
    """The log tools' preview: so many characters, then an ellipsis."""
    t = compact_text(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def format_ago(at: Column, now: Column) -> Column:
    """How long ago, in the largest unit that fits; null without a time."""
    seconds = F.greatest(F.lit(0), F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))) / 1000))
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f"{name} ago"))
    return (
        F.when(at.isNull(), F.lit(None).cast("string"))
        .when(seconds < 5, "just now")
        .when(seconds < 60, unit(seconds, "s"))
        .when(minutes < 60, unit(minutes, "m"))
        .when(hours < 24, unit(hours, "h"))
        .when(days < 30, unit(days, "d"))
        .when(F.floor(days / 30) < 12, unit(F.floor(days / 30), "mo"))
        .otherwise(unit(F.floor(days / 365), "y"))
    )


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text_of(c)) / CHARS_PER_TOKEN)).cast("long")


def safe_id(c: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(text_of(c), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(dashed, 1, 96), F.lit("")), F.lit("item"))


def hash_text(c: Column) -> Column:
    return F.sha2(text_of(c), 256)


def truncate_source(c: Column, most: int) -> Column:
    """The text, or its beginning and a note of how many characters are missing."""
    t = text_of(c)
    note = F.concat(F.lit("\n[truncated "), (F.length(t) - most + 64).cast("string"), F.lit(" chars]"))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, max(0, most - 64)), note))


def session_id_from_path(c: Column, strict: bool = False) -> Column:
    """The id in a file's name; without one a hash of the path, or null if strict."""
    name = F.regexp_extract(text_of(c), r"([^/]*)$", 1)
    found = F.nullif(F.regexp_extract(name, "([0-9a-f]{8}-[0-9a-f-]{27,})", 1), F.lit(""))
    return found if strict else F.coalesce(found, F.substring(hash_text(c), 1, 24))


def shorten(c: Column, most: int, mode: str = "middle") -> Column:
    """The text, or both its ends (middle) or its last part (tail) around an ellipsis."""
    t = text_of(c)
    side = (most - 3) // 2
    cut = F.concat(F.substring(t, 1, side), F.lit("..."), F.right(t, F.lit(side))) if mode == "middle" else F.concat(F.lit("..."), F.right(t, F.lit(most - 3)))
    return F.when(F.length(t) <= most, t).otherwise(cut)


def ceil_cents(c: Column) -> Column:
    """Rounded up to the cent, less a slack for sums of floats; 0 for null, negative and NaN."""
    return F.when(c.isNull() | F.isnan(c) | (c <= 0), 0.0).otherwise(F.ceil((c - 1e-9) * 100) / 100.0)


def is_rate_limited(c: Column) -> Column:
    """Whether an error message is about a rate limit. The phrases are fixed values."""
    return text_of(c).rlike(r"(?i)\b429\b|rate[_ -]?limit|too many requests|tokens per minute|requests per minute|retry after")


def retry_after_ms(c: Column) -> Column:
    """The wait that an error message asks for: a number after one of two fixed phrases, in milliseconds if the word behind it
    begins with ms or milli, in minutes if with another m, else in seconds; null if it asks for none."""
    asked = F.regexp_extract(text_of(c), r"(?i)(?:retry after|try again in)\s+([0-9.]+)\s*(\pL*)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text_of(c), r"(?i)(?:retry after|try again in)\s+[0-9.]+\s*(\pL*)", 1))
    return F.ceil(asked * F.when(unit.rlike("^(?:ms|milli)"), 1).when(unit.startswith("m"), 60_000).otherwise(1_000)).cast("long")


def model_family(c: Column) -> Column:
    t = F.lower(text_of(c))
    any_of = lambda *parts: F.greatest(*[t.contains(p) for p in parts], F.lit(False))
    return F.when(any_of("claude", "anthropic"), "anthropic").when(any_of("gemini", "google"), "google").when(any_of("gpt", "openai", "o3", "o4"), "openai").when(t.isin(*FAMILIES), t).otherwise("unknown")


def norm_role(c: Column) -> Column:
    t = F.lower(text_of(c))
    return F.when(t.isin(*ROLES), t).otherwise("observer")


def event_id(*parts: Column) -> Column:
    """The non-empty parts joined by colons; a hash of all parts if none is there."""
    joined = F.concat_ws(":", *[F.nullif(text_of(p), F.lit("")) for p in parts])
    return F.coalesce(F.nullif(joined, F.lit("")), F.substring(F.sha2(F.concat_ws("|", *[text_of(p) for p in parts]), 256), 1, 24))


def message_id(c: Column, prefix: str = "msg") -> Column:
    """The value if it is an id already, else an id from its hash; empty for empty text."""
    t = text_of(c)
    return F.when(t == "", "").when(t.rlike(f"^{prefix}_[0-9a-f]{{20}}$"), t).otherwise(F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(t, 256), 1, 20)))


_DATA_URL = r"\bdata:{mime}(?:;[^,\s\"'<>]*)?,[^\s\"'<>]+"


def redact_inline(c: Column) -> Column:
    """Inline data URLs replaced by a note, with the type for images, audio and video."""
    typed = F.regexp_replace(text_of(c), _DATA_URL.format(mime=r"((?:image|audio|video)/[A-Za-z0-9.+-]+)"), "[inline $1 data omitted]")
    return F.regexp_replace(typed, _DATA_URL.format(mime=r"[A-Za-z0-9.+-]+/[A-Za-z0-9.+-]+"), "[inline data omitted]")


def encode_uri(c: Column) -> Column:
    """Percent-encoding of a handle's part."""
    out = F.replace(F.url_encode(text_of(c)), F.lit("+"), F.lit("%20"))
    for kept, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(kept))
    return out


def handle(session: Column, ordinal: Column, kind: Column, id_: Column) -> Column:
    """An event's handle: session/<id>/event/<six digits>-<type>-<id>."""
    last = F.concat(F.lpad(ordinal.cast("string"), 6, "0"), F.lit("-"), safe_id(kind), F.lit("-"), F.substring(safe_id(id_), 1, 18))
    return F.concat(F.lit("session/"), encode_uri(session), F.lit("/event/"), encode_uri(last))


def session_link(handle_: Column, index_id: Column | None = None, session_id: Column | None = None) -> Column:
    """A link that opens a handle, by index id if there is one, else by session id."""
    form = lambda c: F.url_encode(c)
    named = F.lit("")
    if session_id is not None:
        named = F.when(text_of(session_id) != "", F.concat(F.lit("sessionId="), form(session_id), F.lit("&"))).otherwise(named)
    if index_id is not None:
        named = F.when(text_of(index_id) != "", F.concat(F.lit("indexId="), form(index_id), F.lit("&"))).otherwise(named)
    return F.concat(F.lit("tool:sessions://open?"), named, F.lit("handle="), form(handle_))


def parse_link(c: Column) -> Column:
    """struct(index_id, session_id, handle) of a link or a bare handle; null for anything else."""
    query = F.regexp_extract(c, r"^tool:[A-Za-z_]+://open\?(.+)$", 1)
    value = lambda *names: F.coalesce(*[F.try_url_decode(F.nullif(F.regexp_extract(query, rf"(?:^|&){n}=([^&]*)", 1), F.lit(""))) for n in names])
    none = F.lit(None).cast("string")
    pick = lambda index, session, h: F.struct(index.alias("index_id"), session.alias("session_id"), h.alias("handle"))
    return F.when(c.startswith("session/"), pick(none, none, c)).when(query != "", pick(value("indexId", "index_id"), value("sessionId"), value("handle")))


def topic_id(handle_: Column, index: Column) -> Column:
    """topic:v1: and the URL-safe base64 of a JSON object of handle and index."""
    body = F.concat(F.lit('{"h":'), F.to_json(F.array(handle_)).substr(F.lit(2), F.length(F.to_json(F.array(handle_))) - 2), F.lit(',"i":'), F.coalesce(index, F.lit(-1)).cast("string"), F.lit("}"))
    coded = F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(body, "utf-8")), "\\s", ""), "+/", "-_"), F.lit("="))
    return F.when(text_of(handle_) == "", "").otherwise(F.concat(F.lit("topic:v1:"), coded))


def parse_topic_id(c: Column) -> Column:
    """struct(handle, topic_index), or null where the id can't be read."""
    coded = F.translate(F.regexp_extract(text_of(c), "^topic:v1:([A-Za-z0-9_-]+)$", 1), "-_", "+/")
    padded = F.rpad(coded, F.ceil(F.length(coded) / 4).cast("int") * 4, F.lit("="))
    body = F.from_json(F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8"), "h string, i int")
    return F.when(body.h.isNotNull() & (body.h != ""), F.struct(body.h.alias("handle"), F.coalesce(body.i, F.lit(-1)).alias("topic_index")))


def relative_handle(c: Column, session: Column) -> Column:
    """The handle as seen from its session: root, or without the session's part."""
    root = F.concat(F.lit("session/"), encode_uri(session))
    return F.when(c == root, "root").when(c.startswith(F.concat(root, F.lit("/"))), F.substr(c, F.length(root) + 2)).otherwise(c)


def absolute_handle(c: Column, session: Column) -> Column:
    root = F.concat(F.lit("session/"), encode_uri(session))
    return F.when(c == "root", root).when(c.startswith("session/"), c).otherwise(F.concat(root, F.lit("/"), c))


def unique(arr: Column) -> Column:
    """Distinct non-empty texts in their first order."""
    return F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != "")))


def normalize_topics(arr: Column, most: int = 8, chars: int = 220) -> Column:
    """Previews of the texts, blanks and repeats (in any case) left out, the first few. A fold that holds no more than those."""
    none = F.array().cast("array<string>")

    def step(acc: Column, t: Column) -> Column:
        topic = preview(t, chars)
        new = (topic != "") & ~F.coalesce(F.array_contains(acc.low, F.lower(topic)), F.lit(False))
        more = F.struct(F.concat(acc.low, F.array(F.lower(topic))).alias("low"), F.concat(acc.kept, F.array(topic)).alias("kept"))
        return F.when(F.size(acc.kept) >= most, acc).when(new, more).otherwise(acc)

    folded = F.aggregate(F.coalesce(arr, none), F.struct(none.alias("low"), none.alias("kept")), step)
    return folded.kept


def cap_links(arr: Column, most: int = 5) -> Column:
    return F.slice(unique(arr), 1, most)


def topic_match(arr: Column, needle: str) -> Column:
    """Whether any topic contains the needle, in any case; an empty needle matches."""
    low = " ".join(needle.lower().split())
    return F.lit(True) if not low else F.coalesce(F.exists(arr, lambda t: F.lower(preview(t, 220)).contains(low)), F.lit(False))


def term_match(c: Column, *terms: str, regex: bool = False) -> Column:
    """Whether the text has any of the terms."""
    hits = [c.rlike(t) if regex else c.contains(t) for t in terms]
    return F.greatest(*hits, F.lit(False)) if hits else F.lit(False)


def scope_regex(scope: Column) -> Column:
    """A scope as a regular expression: plain paths match themselves and what is below; * stays within a part of the
    path, ** does not."""
    escaped = F.regexp_replace(scope, r"([.+^${}()|\[\]\\?])", r"\\$1")
    glob = F.replace(F.replace(F.replace(escaped, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*"))
    return F.when(scope.contains("*"), F.concat(F.lit("^"), glob, F.lit("$"))).otherwise(F.concat(F.lit("^"), F.rtrim(escaped, F.lit("/")), F.lit("(/.*)?$")))


def scope_match(path: Column, scope: Column) -> Column:
    return F.rlike(path, scope_regex(scope))
