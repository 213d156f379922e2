import hashlib

import pytest
from pyspark.sql import functions as F

from seqengine.llm.infill import DELIMITER, ESCAPE, fill_in_middle, infill_report, restored

from .conftest import invented


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text)


ODD = ["", None, "x", "<P>", "a <S> b", "<M", "<P<S", "<<<>>>", DELIMITER, ESCAPE, DELIMITER + ESCAPE + "01" + ESCAPE + DELIMITER, ESCAPE + "0" + DELIMITER + "1"]
ODD += ["\n\r\n", "  \u0085 line", "🤦🏼‍♂️ 𝔘𝔫𝔦 é", "$0 \\1 $1", "\x00\x01\x02\x03", "a" * 5000, "𝔘" * 3000 + "\x01" * 100]


def test_like_brute_force(docs_of, rng):
    rows = [(i, t) for i, t in enumerate(ODD * 12)] + [(i, invented(rng, rng.randint(1, 60))) for i in range(1000, 1300)] + [(None, "no id"), (5, "again"), (5, "again")]
    found = [tuple(r) for r in infill_report(docs_of(rows).withColumn("form", F.lit("z")).withColumn("prefix", F.lit(1))).collect()]
    assert sorted(found, key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_words_and_lines_round_trip(docs_of, rng):
    texts = [*ODD, " leading  and trailing \n\n", "one\ntwo\r\nthree\n", *[invented(rng, 20).replace(" ", "\n", 3) for _ in range(80)]]
    docs = docs_of(list(enumerate(texts)))
    for unit, cut in (("word", lambda t: len(t.split()) + (t[:1].isspace())), ("line", lambda t: len(t.split("\n")) - (t.endswith("\n") or not t))):
        marks = ("[pre]", "{suf}", "(mid)")
        made = fill_in_middle(docs, unit, marks, fim_percent=100, spm_percent=50, seed=7)
        rows = made.withColumn("again", restored(F.col("output"), F.col("form"), marks)).collect()
        for r in rows:
            text = texts[r.doc_id] or ""
            assert r.again == text and (r.form != "plain" or text == "")
            if r.form != "plain":
                assert r.prefix + r.middle + r.suffix == text
                for part in (r.prefix, r.prefix + r.middle):
                    assert part in ("", text) or (part.endswith("\n") if unit == "line" else part[-1].isspace() and not text[len(part)].isspace())
            if text.isascii() and not any(c in text for c in "\x00\x1c"):
                assert r.n == cut(text)


def test_marks_and_empty_table(docs_of, empty):
    assert infill_report(empty).isEmpty()
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<<", "<S>", "<M>"), ("<P>", "S<", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(empty, marks=marks)
