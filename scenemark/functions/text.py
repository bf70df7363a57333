"""Tagged text, prompts and reply checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions.answers import let, literal_map
from scenemark.functions.rnd import _c

TAG_PATTERN = r"<([^>]+)>([^<]*?)</\1>"


def strip(col) -> Column:
    """Remove white space of any kind on both ends."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def parse_tags(col) -> Column:
    """Array of struct(tag, content) in text order."""
    tags = F.regexp_extract_all(_c(col), F.lit(TAG_PATTERN), 1)
    body = F.regexp_extract_all(_c(col), F.lit(TAG_PATTERN), 2)
    return F.zip_with(tags, body, lambda t, c: F.struct(t.alias("tag"), strip(c).alias("content")))


def _emit(parsed: Column, order: list[str], default) -> Column:
    def one(t):
        hits = F.filter(parsed, lambda p: p["tag"] == t)
        joined = F.array_join(F.transform(hits, lambda p: p["content"]), "")
        text = F.when(F.size(hits) > 0, joined).otherwise(default(t))
        return F.when(F.length(text) > 0, F.concat(F.lit("<"), t, F.lit(">"), text, F.lit("</"), t, F.lit(">")))

    parts = F.transform(F.array(*[F.lit(t) for t in order]), one)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " ")


def reorder_tags(col, order: list[str] = dims.TAGS) -> Column:
    """TXT-1: repeated tags merged, known tags in fixed order, unknown and empty dropped."""
    return let(parse_tags(col), lambda p: _emit(p, order, lambda t: F.lit("")))


def fill_default_tags(col, defaults: dict[str, str] = dims.TAG_DEFAULTS, order: list[str] = dims.TAGS) -> Column:
    """TXT-4: absent tags take their default text, then TXT-1."""
    table = literal_map(defaults)
    return let(
        parse_tags(col), lambda p: _emit(p, order, lambda t: F.coalesce(F.try_element_at(table, t), F.lit("")))
    )


def fill_prompt(template: str, **values) -> Column:
    """TXT-5: ``{name}`` placeholders replaced by columns; structs become JSON."""
    out = F.lit(template)
    for name, col in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), _c(col))
    return out


def is_degenerate(col, k: int = 100) -> Column:
    """TXT-8: the same character at least ``k`` times in a row."""
    return _c(col).rlike(rf"(.)\1{{{k - 1}}}")


def clipped_reply(col, k: int = 100) -> Column:
    """TXT-8: first ``k`` characters, FAILED if they only repeat."""
    head = F.substring(_c(col), 1, k)
    return F.when(is_degenerate(head, k), "FAILED").otherwise(head)


def last_words(col, n: int) -> Column:
    """TXT-9: the last ``n`` blank-separated pieces; unchanged for n <= 0."""
    if n <= 0:
        return _c(col)
    return let(
        F.split(_c(col), " "),
        lambda w: F.array_join(F.when(F.size(w) > n, F.slice(w, F.lit(-n), F.lit(n))).otherwise(w), " "),
    )


def py_list(choices, as_numbers) -> Column:
    """A list in Python's literal form: ['a', 'b'] or [0, 1]."""

    def quoted(c):
        esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        dbl = F.concat(F.lit('"'), esc, F.lit('"'))
        sgl = F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(c.contains("'") & ~c.contains('"'), dbl).otherwise(sgl)

    body = F.when(_c(as_numbers), F.array_join(_c(choices), ", ")).otherwise(
        F.array_join(F.transform(_c(choices), quoted), ", ")
    )
    return F.concat(F.lit("["), body, F.lit("]"))
