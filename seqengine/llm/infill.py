"""Fill-in-middle transformation by escaped marker injection, in column functions only.

A delimiter that the text can't hold is made by escaping: the escape character and the
delimiter become two characters each. `regexp_replace` then appends the delimiter after each unit,
so that units are counted by counting delimiters and any range of them is cut out by
`substring_index`; the parts are unescaped and put together around marks. The cuts and the
form come from a hash of the document's id, so a rerun gives the same.

Rows and edge cases: a null or empty text gives an empty plain text; a text that holds a mark
stays plain; a null doc_id counts as an empty one in the hash; repeated rows are each
transformed, in the same way; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

DELIMITER, ESCAPE = "\x01", "\x02"
#: Patterns of units, which cover any text; an escaped character in it is the escape and a digit.
UNITS = {
    "character": rf"(?s){ESCAPE}.|[^{ESCAPE}]",
    "word": r"\S+\s*|\s+",
    "line": r"[^\n]*\n|[^\n]+",
}


def escaped(text: Column) -> Column:
    """The text without the delimiter."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(DELIMITER), F.lit(f"{ESCAPE}1"))


def unescaped(marked: Column) -> Column:
    """The text of some marked units."""
    plain = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(f"{ESCAPE}1"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def marked_units(text: Column, unit: str) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escaped(text), UNITS[unit], f"$0{DELIMITER}")


def parts_of(marked: Column, first: Column, last: Column) -> Column:
    """Units first to last (not included) of a marked text."""
    return _index(_index(marked, DELIMITER, last), DELIMITER, first - last)


def _index(text: Column, mark: str, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), count.cast("int"))


def _draws(doc_id: str, seed: int) -> Column:
    """Four numbers of 32 bits from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def _checked(marks: tuple[str, str, str]) -> None:
    """A mark must be found again wherever it stands between texts that hold none."""
    for mark in marks:
        if len(mark) < 2 or any(mark[0] in other[1:] for other in marks) or mark[1:].count(mark[0]):
            raise ValueError(f"marks need two characters at least, the first of which is nowhere else in them: {marks}")
    if len(set(marks)) < 3 or any(a != b and a in b for a in marks for b in marks):
        raise ValueError(f"marks must differ, and none may hold another: {marks}")


def fill_in_middle(docs: DataFrame, unit: str = "character", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), fim_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output for each of docs (doc_id, text).

    psm is the prefix, suffix and middle, each behind its mark; spm has the suffix before the prefix.
    marks: of prefix, suffix and middle. fim_percent: documents that are transformed at all;
    spm_percent: those of them with the suffix first.
    """
    _checked(marks)
    p, s, m = map(F.lit, marks)
    text, draw = whole_text(), lambda k: F.col("_draws")[k]
    rows = docs.select("doc_id", text.alias("_text"), _draws("doc_id", seed).alias("_draws"))
    rows = rows.select("doc_id", "_text", "_draws", marked_units(F.col("_text"), unit).alias("_marked"))
    rows = rows.withColumn("n", (F.octet_length("_marked") - F.octet_length(F.replace(F.col("_marked"), F.lit(DELIMITER), F.lit("")))).cast("long"))
    one, two = (F.pmod(draw(k), F.col("n") + 1) for k in (0, 1))
    holds = F.greatest(*[F.contains(F.col("_text"), mark) for mark in (p, s, m)])
    plain = (F.col("_text") == "") | holds | (F.pmod(draw(2), F.lit(100)) >= fim_percent)
    form = F.when(plain, "plain").when(F.pmod(draw(3), F.lit(100)) < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "_text", "_marked", "n", form.alias("form"), F.least(one, two).alias("_from"), F.greatest(one, two).alias("_to"))
    marked, low, high, n = map(F.col, ("_marked", "_from", "_to", "n"))
    cut = lambda part: F.when(F.col("form") != "plain", unescaped(part))
    rows = rows.select(
        "doc_id",
        "n",
        "form",
        "_text",
        cut(_index(marked, DELIMITER, low)).alias("prefix"),
        cut(parts_of(marked, low, high)).alias("middle"),
        cut(_index(marked, DELIMITER, high - n - 1)).alias("suffix"),  # behind the last delimiter is an empty part
    )
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made from, read from output and form alone."""
    p, s, m = marks
    body, middle = _index(output, m, F.lit(1)), _index(output, m, F.lit(-1))
    psm = F.concat(_index(_index(body, s, F.lit(1)), p, F.lit(-1)), middle, _index(body, s, F.lit(-1)))
    spm = F.concat(_index(body, p, F.lit(-1)), middle, _index(_index(body, p, F.lit(1)), s, F.lit(-1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for each of docs (doc_id, text)."""
    made = fill_in_middle(docs)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
