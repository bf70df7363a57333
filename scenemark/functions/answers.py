"""Answer parsing and per-row scores as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenemark import dims
from scenemark.functions.rnd import _c

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_of(arr: Column) -> Column:
    """Last element, NULL for an empty array."""
    return F.try_element_at(arr, F.lit(-1))


def find_all(col, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(pattern), group)


def find_first(col, pattern: str, group: int = 1) -> Column:
    """First match, NULL (not '') where there is none."""
    return F.get(find_all(col, pattern, group), F.lit(0))


def letter_of(idx: Column) -> Column:
    """0 -> A, 1 -> B …; NULL outside the choices."""
    return F.when((idx >= 0) & (idx < 26), F.substring(F.lit(LETTERS), (idx + 1).cast("int"), F.lit(1)))


def truth_index(choices, answer) -> Column:
    """EVA-3: 0-based position of the answer among the choices; NULL if absent."""
    pos = F.array_position(_c(choices), _c(answer))
    return F.when(pos > 0, pos - 1)


def find_choice(resp, choices) -> Column:
    """EVA-2: last stand-alone A–D, else the letter of the only choice quoted, else '-'."""
    letter = last_of(find_all(resp, r"(?U)\b([ABCD])\b"))
    hits = F.filter(
        F.transform(_c(choices), lambda c, i: F.when(_c(resp).contains(c), i)), lambda x: x.isNotNull()
    )
    return F.coalesce(letter, F.when(F.size(hits) == 1, letter_of(F.get(hits, F.lit(0)))), F.lit("-"))


def extract_range(col) -> Column:
    """EVA-6: numbers of a text in mm; NULL when it has none."""
    c, num = _c(col), r"(\d+\.?\d*)"
    scale = F.when(c.rlike("(?:μ|microns?)"), F.lit(0.001)).otherwise(F.lit(1.0))

    def nums(arr: Column, factor: Column | None = None) -> Column:
        vals = F.transform(arr, lambda x: x.cast("double") if factor is None else x.cast("double") * factor)
        return F.when(F.size(arr) > 0, vals)

    def pair(pattern: str) -> Column:
        a, b = find_first(c, pattern, 1), find_first(c, pattern, 2)
        return F.when(a.isNotNull(), F.array(a.cast("double") * scale, b.cast("double") * scale))

    return F.coalesce(
        nums(find_all(c, rf"1:{num}")),
        nums(find_all(c, rf"{num}:1")),
        pair(rf"{num}\s*-\s*{num}"),
        pair(rf"{num}\s+to\s+{num}"),
        pair(rf"{num}\s+or\s+{num}"),
        pair(rf"near\s+{num}.*?(?:increasing|decreasing)\s+to\s+(?:near\s+)?{num}"),
        nums(find_all(c, num), scale),
    )


def array_avg(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)


def range_score(ref: Column, pred: Column, low: float = 0.05, high: float = 0.3) -> Column:
    """EVA-7: 0–10 by relative error outside the reference range; NULL without a usable
    reference, 0 without a prediction."""

    def scale(err):
        return (
            F.when(err > high, F.lit(1.0)).when(err < low, F.lit(0.0)).otherwise((err - low) / (high - low))
        )

    def rate(v):
        p, lo, hi = v["p"], v["lo"], v["hi"]
        err = (
            F.when(p < lo, F.try_divide(lo - p, lo)).when(p > hi, F.try_divide(p - hi, hi)).otherwise(F.lit(0.0))
        )
        points = let(err, lambda e: F.bround(F.lit(10.0) * (F.lit(1.0) - scale(e)), 0))
        return F.when(lo.isNull(), F.lit(None).cast("double")).when(p.isNull(), F.lit(0.0)).otherwise(points)

    bounds = let(ref, lambda r: F.struct(F.array_min(r).alias("lo"), F.array_max(r).alias("hi")))
    args = F.struct(let(pred, array_avg).alias("p"), bounds["lo"].alias("lo"), bounds["hi"].alias("hi"))
    return let(args, rate)


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _mapped(word: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(table), word)


def word_class(col, table: dict[str, str], bounded: bool = True) -> Column:
    """Class of the first table word found in a text; NULL if none."""
    body = "|".join(table)
    return _mapped(find_first(col, rf"(?U)\b({body})\b" if bounded else f"({body})"), table)


def chomata_descriptor(col, default: str = "absent") -> Column:
    """EVA-8: struct(development, height, width)."""
    c = _c(col)
    massive, small = c.rlike(r"(?U)\bmassive\b"), c.rlike(r"(?U)\b(small|tiny|minute)\b")

    def dim(table, big, little):
        return F.coalesce(
            word_class(c, table), F.when(massive, big).when(small, little).otherwise("moderate")
        )

    return F.struct(
        F.coalesce(word_class(c, dims.DEVELOPMENT_WORDS, bounded=False), F.lit(default)).alias("development"),
        dim(dims.HEIGHT_WORDS, "high", "low").alias("height"),
        dim(dims.WIDTH_WORDS, "wide", "narrow").alias("width"),
    )


def chomata_rating(out, ref) -> Column:
    """EVA-8: 4 points for development, 3 each for height and width."""
    o, r = chomata_descriptor(out, "none"), chomata_descriptor(ref, "none")
    od, rd = o["development"], r["development"]

    def part(k):
        return F.when(o[k] == r[k], 3).when((o[k] == "moderate") | (r[k] == "moderate"), 1).otherwise(0)

    dev = F.when((od == rd) | (rd == "none"), 4).otherwise(0)
    return (
        F.when((od != rd) & ((od == "absent") | (rd == "absent")), 0)
        .otherwise(dev + part("height") + part("width"))
        .cast("double")
    )


def axis_shape(col, default: str = "straight") -> Column:
    """EVA-9: first axis-shape word."""
    return F.coalesce(find_first(col, r"(?U)\b(" + "|".join(dims.AXIS_WORDS) + r")\b"), F.lit(default))


def axis_rating(out, ref) -> Column:
    o, r = axis_shape(out, "none"), axis_shape(ref, "straight")
    bent, wavy = ["convex", "concave", "curved"], ["irregular", "sinuous"]
    same = (o == r) | (o.isin(bent) & r.isin(bent)) | (o.isin(wavy) & r.isin(wavy))
    return F.when(same, 10.0).otherwise(0.0)


def tunnel_shape(col, default: str = "moderate") -> Column:
    """EVA-10: struct(height, width)."""
    return F.struct(
        F.coalesce(word_class(col, dims.HEIGHT_WORDS), F.lit(default)).alias("height"),
        F.coalesce(word_class(col, dims.WIDTH_WORDS), F.lit(default)).alias("width"),
    )


def plain_text(col) -> Column:
    """Lower-case, trimmed, without punctuation."""
    return F.regexp_replace(F.trim(F.lower(_c(col))), r"(?U)[^\w\s]", "")


def words_of(col) -> Column:
    """Whitespace-separated words of a text, empty ones dropped."""
    return F.filter(F.split(_c(col), r"(?U)\s+"), lambda w: w != "")


def relaxed_match(answer, extraction, tol: float = 0.05) -> Column:
    """EVA-16: relative error within ``tol`` for numbers, else containment."""
    a = F.trim(_c(answer)).try_cast("double")
    e = find_first(extraction, r"(-?\d+\.?\d*)").try_cast("double")
    close = F.when(a == 0, F.abs(e) < 1e-5).otherwise(F.abs(a - e) / F.abs(a) <= tol)
    text = F.contains(F.lower(F.trim(_c(extraction))), F.lower(F.trim(_c(answer))))
    return F.when(a.isNotNull() & e.isNotNull(), close).otherwise(text)


def anls_ref(pred, ref, tau: float = 0.5) -> Column:
    """EVA-17: edit similarity normalised by the reference length, 0 below ``tau``."""
    p, r = plain_text(pred), plain_text(ref)
    s = 1.0 - F.levenshtein(p, r) / F.greatest(F.length(r), F.lit(1))
    return F.when((F.length(r) == 0) | (s < tau), 0.0).otherwise(s)


def anls_multi(pred, gts, tau: float = 0.5) -> Column:
    """EVA-18: best edit similarity over several answers, by the longer string."""
    p = F.trim(F.lower(_c(pred)))

    def one(g):
        t = F.trim(F.lower(g))
        s = 1.0 - F.try_divide(F.levenshtein(p, t), F.greatest(F.length(p), F.length(t)))
        return F.when(s >= tau, s).otherwise(0.0)

    return F.array_max(F.transform(_c(gts), one))


def token_counts(words: Column) -> Column:
    return F.transform(
        F.array_distinct(words), lambda w: F.struct(w.alias("w"), F.size(F.filter(words, lambda x: x == w)).alias("n"))
    )


def normalise_answer(extraction, choices, question_type, answer_type, precision) -> Column:
    """EVA-21: extraction cast to the answer type; nearest choice for multiple choice."""
    e, ch = F.trim(_c(extraction)), _c(choices)
    letter = F.coalesce(F.upper(find_first(e, r"\(([a-zA-Z])\)")), e)
    idx = F.when(F.length(letter) == 1, F.instr(F.lit(LETTERS), letter) - 1)
    nearest = F.array_min(
        F.transform(ch, lambda c, i: F.struct(F.levenshtein(letter, c).alias("d"), i.alias("i"), c.alias("c")))
    )["c"]
    picked = F.when((idx >= 0) & (idx < F.size(ch)), F.get(ch, idx)).otherwise(nearest)
    num = e.try_cast("double")
    return (
        F.when(_c(question_type) == "multi_choice", F.when(F.length(e) > 0, picked))
        .when(_c(answer_type) == "integer", num.try_cast("bigint").cast("string"))
        .when(_c(answer_type) == "float", float_text(num, _c(precision)))
        .otherwise(_c(extraction))
    )


def float_text(num: Column, precision: Column) -> Column:
    """Number rounded half-even to 0–6 digits, as text."""
    out = F.when(precision == 0, F.bround(num, 0).cast("string"))
    for p in range(1, 7):
        out = out.when(precision == p, F.bround(num, p).cast("string"))
    return out


def yes_no(col) -> Column:
    """EVA-27: 'no' if the first sentence contains No/not/no, else 'yes'."""
    first = F.get(F.split(_c(col), r"\."), F.lit(0))
    words = F.split(F.replace(first, F.lit(","), F.lit("")), " ")
    return F.when(F.arrays_overlap(words, F.array(F.lit("No"), F.lit("not"), F.lit("no"))), "no").otherwise("yes")


def science_letter(text, options: str = "ABCDE") -> Column:
    """EVA-28: 'A', 'A. …' or a single 'The answer is X.', else FAILED."""
    t = _c(text)
    head = F.substring(t, 1, 1)
    said = find_all(t, r"The answer is ([A-Z]).")
    return (
        F.when(t.isin(*options), t)
        .when(head.isin(*options) & (F.substring(t, 2, 2) == ". "), head)
        .when(F.size(said) == 1, F.get(said, F.lit(0)))
        .otherwise("FAILED")
    )


def answer_is_letter(text) -> Column:
    """The single 'The answer is X.' of a reply, else FAILED."""
    said = find_all(text, r"The answer is ([A-Z]).")
    return F.when(F.size(said) == 1, F.get(said, F.lit(0))).otherwise("FAILED")


def option_index(letter: Column, n_choices: Column, options: str = "ABCDE") -> Column:
    """0-based option of a letter, −1 when it is not among the first ``n_choices``."""
    i = F.instr(F.lit(options), letter) - 1
    return F.when((F.length(letter) == 1) & (i >= 0) & (i < n_choices), i).otherwise(-1)


def first_letter_match(response, candidates, answer) -> Column:
    """EVA-30: reply agrees by index, choice text, first word or full text; at most once."""
    r, c, a = _c(response), _c(candidates), _c(answer)
    idx = F.ascii(F.substring(r, 1, 1)) - 65
    named = F.when((idx >= 0) & (idx < F.size(c)), F.get(c, idx) == a).otherwise(F.lit(False))
    return (
        (F.length(r) > 0)
        & ((idx.cast("string") == a) | named | (F.get(F.split(r, " "), F.lit(0)) == a) | (r == a))
    )


def vqa_normalise(col) -> Column:
    """EVA-31: punctuation, number words, articles and contractions."""
    t = F.trim(
        F.replace(
            F.replace(F.replace(F.lower(_c(col)), F.lit(","), F.lit("")), F.lit("?"), F.lit("")),
            F.lit("'s"),
            F.lit(" 's"),
        )
    )
    src = F.trim(F.translate(t, "\n\t", "  "))

    def swap(words, table):
        # a hash look-up tells whether the map, which is searched entry by entry, has the word
        named = literal_map(table)
        return F.transform(words, lambda w: F.when(w.isin(*table), F.try_element_at(named, w)).otherwise(w))

    def strip_marks(v):
        text, comma = v["t"], v["c"]
        out = text
        for p in dims.PUNCTUATION:
            glued = comma | text.contains(p + " ") | text.contains(" " + p)
            out = F.replace(out, F.lit(p), F.when(glued, "").otherwise(" "))
        return F.regexp_replace(out, r"\.(?!\d)", "")

    # most answers have no marks, and no white space but blanks
    marked = "[" + re.escape("".join(dims.PUNCTUATION) + ".") + "]"
    plain = lambda v: F.when(v["t"].rlike(marked), strip_marks(v)).otherwise(v["t"])
    split = lambda x: F.when(x.rlike(r"(?U)[\s&&[^ ]]"), words_of(x)).otherwise(F.filter(F.split(x, " "), lambda w: w != ""))

    args = let(src, lambda s: F.struct(s.alias("t"), s.rlike(r"(?<=\d),+(?=\d)").alias("c")))
    words = swap(let(let(args, plain), split), dims.NUMBER_WORDS)
    kept = F.filter(words, lambda w: ~w.isin(*dims.ARTICLES))
    return F.array_join(swap(kept, dims.CONTRACTIONS), " ")


def soft_accuracy(pred, gts) -> Column:
    """EVA-32: leave-one-out agreement over the (ten) answers in closed form."""
    n = F.size(_c(gts))
    m = F.size(F.filter(_c(gts), lambda g: g == _c(pred)))
    return (
        m * F.least(F.lit(1.0), (m - 1) / F.lit(3.0)) + (n - m) * F.least(F.lit(1.0), m / F.lit(3.0))
    ) / n


def any_match(pred, gts) -> Column:
    """EVA-33."""
    return F.array_contains(_c(gts), _c(pred))


def prompt_question(prompt) -> Column:
    """EVA-35: lower-cased question of a prompt in one of three layouts; NULL otherwise."""
    p = _c(prompt)
    lines = F.split(p, "\n")
    n, first, second = F.size(lines), F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    return F.lower(
        F.when(p.startswith("OCR tokens: "), find_first(p, r"(?s)Question: (.*?) Short answer:"))
        .when(
            p.contains("Reference OCR token: ") & (n == 3),
            F.when(p.startswith("Reference OCR token:"), second).otherwise(first),
        )
        .when(n == 2, first)
    )


def parse_pair(col) -> Column:
    """EVA-36: struct(s1, s2) of the first review line, else (−1, −1)."""
    line = F.replace(F.get(F.split(_c(col), "\n"), F.lit(0)), F.lit(","), F.lit(" "))
    parts = F.split(line, " ")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    ok = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    return F.struct(F.when(ok, a).otherwise(-1.0).alias("s1"), F.when(ok, b).otherwise(-1.0).alias("s2"))


def decimals_instruction(answer) -> Column:
    """EVA-42: how precise the final number must be."""
    dec = F.get(F.split(_c(answer), r"\."), F.lit(1))
    return F.when(dec.isNull(), "* Your final answer must be an exact integer.").otherwise(
        F.concat(F.lit("* Your final answer must be a number with "), F.length(dec), F.lit(" decimal places."))
    )


# --- EVA-24: final answer of a worked solution -------------------------------------------------

# fixed values: phrases that introduce an answer, and LaTeX clean-up in order
ANSWER_PHRASES = ["the final answer is", "the answer is", "the correct answer is", "the answer should be"]
LATEX_FIRST = [
    (" ", ""), ("\\,", ""), ("+\\infty", "\\infty"), ("\\\\", "\\"), ("\n", ""), ("\\text", ""), ("\\mbox", ""),
    ("bmatrix", "pmatrix"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("{m}^3", ""), ("m^3", ""),
    ("{units}", ""), ("units", ""), ("{km}", ""), ("km", ""),
]
LATEX_SECOND = [
    ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""),
    ("^\\circ", ""), ("\\$", ""), ("$", ""),
]
BRACKETED = [("(" + c + ")", c) for c in "abcde"] + [("{" + c + "}", c) for c in "abcde"]


def replace_all(c: Column, table: list[tuple[str, str]]) -> Column:
    for a, b in table:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def _only_value(c: Column, mark: str) -> Column:
    """What follows ``mark`` if it occurs exactly once."""
    return F.when(F.size(F.split(c, F.lit(mark.replace("\\", "\\\\")))) == 2, _after_last(c, mark)).otherwise(c)


def _trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _announced(c: Column) -> Column:
    """Sentence after the last answer phrase, for each phrase in turn."""
    for phrase in ANSWER_PHRASES:
        for p in (phrase, phrase.replace("the", "The")):
            c = let(c, _phrase_step(p))
    return c


def _phrase_step(phrase: str):
    def step(v):
        tail = _trim_ws(_after_last(v, phrase))
        first = F.substring_index(F.substring_index(tail, "\n", 1), ". ", 1)
        return F.when(v.contains(phrase), first).otherwise(_trim_ws(v))

    return step


def clean_latex(col) -> Column:
    """LaTeX answer in plain form: formatting dropped, the value after '=' or '\\approx'
    taken, square roots and fractions braced, a/b and 0.5 as fractions."""
    s = replace_all(_c(col), LATEX_SECOND)
    s = F.substring_index(s, "\\text{ ", 1)
    s = replace_all(s, [("\\%", ""), ("%", ""), (" .", " 0."), ("{.", "{0.")])
    s = let(s, lambda v: F.when(v.startswith("."), F.concat(F.lit("0"), v)).otherwise(v))
    s = let(s, lambda v: _only_value(v, "="))
    s = let(s, lambda v: _only_value(v, "\\approx"))
    s = F.regexp_replace(s, r"\\sqrt(?!\\sqrt)([^{])", r"\\sqrt{$1}")
    s = F.replace(s, F.lit(" "), F.lit(""))

    def fracs(v):
        braced = F.regexp_replace(
            F.regexp_replace(v, r"\\frac([^{])\{", r"\\frac{$1}{"), r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"
        )
        short = v.rlike(r"\\frac[^{]?(?=\\frac|$)")
        return F.when(v.contains("sqrt") & ~short, braced).otherwise(v)

    s = let(s, fracs)
    s = let(s, lambda v: F.when(v == "0.5", "\\frac{1}{2}").otherwise(v))
    return F.regexp_replace(s, r"^(-?[1-9]\d*|0)/(-?[1-9]\d*|0)$", r"\\frac{$1}{$2}")


def _math_part(c: Column) -> Column:
    s = F.replace(F.lower(c), F.lit("{}"), F.lit(""))
    s = let(s, lambda v: F.coalesce(last_of(find_all(v, r"(?s)oxed\{(.*)\}")), v))

    def closed(v):
        a, b = F.instr(v, "{"), F.instr(v, "}")
        return F.when((b > 0) & ((a == 0) | (b < a)), F.substring_index(v, "}", 1)).otherwise(v)

    s = let(s, closed)
    s = _after_last(_after_last(s, "="), "\\approx")
    return clean_latex(replace_all(s, LATEX_FIRST))


def final_answer(col) -> Column:
    """EVA-24: letter A–E, number after 'is ', announced or boxed answer, cleaned."""
    text = _trim_ws(_c(col))

    def letter(v):
        out = F.when(v.rlike(r"(?U)\bA\b"), "A")
        for c in "BCDE":
            out = out.when(v.rlike(rf"(?U)\b{c}\b"), c)
        return out.otherwise(v)

    def number(v):
        tail = F.regexp_replace(_after_last(v, "is "), r"\.+$", "")
        return let(tail, lambda t: F.when(t.try_cast("double").isNotNull(), t).otherwise(v))

    def boxed(v):
        n = F.size(F.split(v, r"oxed\{")) - 1
        return F.when(n == 0, _announced(v)).when(n > 1, F.concat(F.lit("\\boxed{"), _after_last(v, "oxed{"))).otherwise(v)

    s = let(let(let(text, letter), number), boxed)
    s = replace_all(_math_part(s), BRACKETED)
    return _trim_ws(F.regexp_replace(F.regexp_replace(s, r"\.+$", ""), r"^:+", ""))
