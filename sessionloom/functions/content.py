"""Open JSON values (variants): content blocks, calls, reasoning, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def blocks(v: Column) -> Column:
    """The value as an array of variants: arrays as they are, text as one text block, objects alone, null as none."""
    one = F.array(F.when(is_text(v), F.try_parse_json(F.to_json(F.struct(F.lit("text").alias("type"), _get(v, "").alias("text"))))).otherwise(v))
    return F.when(v.isNull() | F.is_variant_null(v), F.expr("cast(array() as array<variant>)")).when(is_array(v), F.try_variant_get(v, "$", "array<variant>")).otherwise(one)


def normalize_content(v: Column) -> Column:
    """array of (type, text, json): text blocks have their text, typed parts and others their JSON; empty ones are dropped."""
    kind = lambda b: F.coalesce(_get(b, "type"), F.when(is_text(b), "text"), F.lit("json"))
    shaped = F.transform(blocks(v), lambda b: F.struct(F.when(kind(b).isin("text", "input_text", "output_text"), "text").otherwise(kind(b)).alias("type"), F.coalesce(_get(b, "text"), F.when(is_text(b), _get(b, ""))).alias("text"), F.to_json(b).alias("json")))
    return F.filter(shaped, lambda b: (b.type != "text") | (T.text_of(b.text) != ""))


def media(b: Column) -> Column:
    """A media part as text: [image: <url>; detail=<detail>], data URLs redacted."""
    url = F.coalesce(_get(b, "image_url.url"), _get(b, "image_url"), _get(b, "url.url"), _get(b, "url"), F.lit(""))
    detail = F.coalesce(_get(b, "image_url.detail"), _get(b, "detail"))
    shown = F.when(url != "", T.preview(T.redact_inline(url), 240)).otherwise("attached image")
    return F.concat(F.lit("[image: "), shown, F.when(T.text_of(detail) != "", F.concat(F.lit("; detail="), T.redact_inline(detail))).otherwise(""), F.lit("]"))


def content_text(v: Column) -> Column:
    """All parts' text joined by newlines; media by a note."""

    def part(b: Column) -> Column:
        is_media = F.coalesce(_get(b, "type").isin("input_image", "image_url", "image"), F.lit(False)) | F.try_variant_get(b, "$.image_url", "variant").isNotNull()
        return F.when(is_text(b), _get(b, "")).when(is_media, media(b)).otherwise(F.coalesce(_get(b, "text"), F.to_json(b)))

    return F.array_join(F.filter(F.transform(blocks(v), part), lambda t: T.text_of(t) != ""), "\n")


def reasoning_flags(v: Column) -> Column:
    """array of (has_summary, has_encrypted, has_signature); the text itself is never kept."""
    there = lambda b, *names: F.greatest(*[T.text_of(F.to_json(F.try_variant_get(b, f"$.{n}", "variant"))) .isin("", "[]", '""', "null") == F.lit(False) for n in names], F.lit(False))
    return F.transform(blocks(v), lambda b: F.struct(there(b, "summary").alias("has_summary"), there(b, "encrypted_content", "encrypted").alias("has_encrypted"), there(b, "signature").alias("has_signature")))


def norm_call(v: Column) -> Column:
    """(id, name, arguments) of a call, over the names that logs use."""
    arguments = F.coalesce(*[F.to_json(F.try_variant_get(v, f"$.{n}", "variant")) for n in ("arguments", "input", "args", "action")])
    return F.struct(F.coalesce(*[_get(v, n) for n in ("id", "call_id", "callId")]).alias("id"), F.coalesce(*[_get(v, n) for n in ("name", "tool_name", "toolName")]).alias("name"), arguments.alias("arguments"))


def payload_digest(v: Column, keys: list[str]) -> Column:
    """A map of the given fields: text as a preview of 600 characters, arrays as [n items], objects as their keys, numbers as they are."""

    def shown(name: str) -> Column:
        x = F.try_variant_get(v, f"$.{name}", "variant")
        items = F.concat(F.lit("["), F.size(F.try_variant_get(x, "$", "array<variant>")).cast("string"), F.lit(" items]"))
        names = F.concat(F.lit("{"), F.array_join(F.array_sort(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>"))), ", "), F.lit("}"))
        return F.when(is_array(x), items).when(is_object(x), names).when(is_text(x), T.preview(_get(x, ""), 600)).otherwise(_get(x, ""))

    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), shown(k).alias("v")) for k in keys]), lambda p: p.v.isNotNull())
    return F.map_from_entries(pairs)


def event_text(text: Column, parts: Column, *others: Column, before: tuple[Column, ...] = ()) -> Column:
    """What is searched of an event, joined by newlines, empty pieces left out: what stands `before` (title, role), the texts of its
    content blocks (see normalize_content), else its plain text, and the others in order (reasoning summaries, the call's name and arguments, its output,
    usage as JSON)."""
    joined = F.array_join(F.transform(parts, lambda b: F.coalesce(b.text, b.json)), "\n")
    pieces = [*before, F.coalesce(F.nullif(joined, F.lit("")), text), *others]
    return F.array_join(F.filter(F.array(*[T.text_of(p) for p in pieces]), lambda p: p != ""), "\n")


def canonical_tool_result(output: Column) -> Column:
    """(texts, content, is_verbatim, omitted) of a tool's output: JSON envelopes are unwrapped; lists of results or refs
    become their distinct texts in order, an opened node its content with its flags; anything else stays as content."""
    v = F.try_parse_json(F.when(output.rlike(r"^\s*[\[{]"), output))
    inner = F.coalesce(F.try_variant_get(v, "$.structuredContent", "variant"), F.try_variant_get(v, "$.result", "variant"), v)
    listed = F.coalesce(F.try_variant_get(inner, "$.refs", "array<variant>"), F.try_variant_get(inner, "$.results", "array<variant>"), F.try_variant_get(inner, "$.children", "array<variant>"))
    texts = F.array_distinct(F.filter(F.transform(listed, lambda r: F.coalesce(_get(r, "text"), _get(r, "head"))), lambda t: T.text_of(t) != ""))
    return F.struct(texts.alias("texts"), F.when(listed.isNull(), F.coalesce(_get(inner, "content"), output)).alias("content"), F.coalesce(_get(inner, "isVerbatim", "boolean"), F.lit(False)).alias("is_verbatim"), F.coalesce(_get(inner, "omittedTokenCount", "bigint"), F.lit(0)).alias("omitted"))


def valid_text(c: Column) -> Column:
    """Text whose bytes are valid UTF-8: what is not becomes U+FFFD."""
    return F.make_valid_utf8(c)
