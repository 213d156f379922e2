"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontaminate import contamination_report, find_contamination
from .exact_dedup import exact_groups
from .html_extract import extract_text
from .infill import infill_report
from .langid import language_report
from .license_scan import SPEAKS, TEMPLATES, corpus_paths, scan_licenses
from .line_dedup import line_report
from .neardup import near_duplicates
from .packing import pack_documents
from .periodic_runs import periodic_runs, runs_report, with_planted_runs
from .quality import score_quality, train_quality
from .token_counts import count_edited
from .toxicity import score_toxicity, train_toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every document, then counts it again after five edits: rules of the text's length, one of which empties some
    leaves and the next inserts there, and one that splits a word."""
    docs = read_table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda pos, removed, inserted: F.struct(pos.cast("long").alias("pos"), removed.cast("long").alias("removed"), inserted.alias("inserted"))
    edits = F.array(
        edit(F.floor(n / 3), F.lit(0), F.concat(F.lit(" revised "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        edit(F.floor(n / 2), F.floor(n / 5), F.lit("")),
        edit(F.floor(n / 2), F.lit(0), F.lit("x")),
        edit(F.floor(n / 4), F.lit(3), F.lit("-")),
        edit(F.lit(0), F.lit(0), F.lit("Revision 2.\n")),
    )
    out = count_edited(docs.select("doc_id", "text", edits.alias("edits")))
    return out.select("doc_id", "n_tokens_before", "n_tokens", "n_encoded_chars", F.length("text").cast("long").alias("n_chars"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, read_table(spark, sf_dir, "labels")))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(corpus_paths(read_table(spark, sf_dir, "documents")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_report(periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")), min_length=6, min_exponent=4))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_report(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


ALL = (
    op1_token_counts,
    op2_exact_dedup,
    op3_best_fit_packing,
    op4_quality,
    op5_minhash_near_dedup,
    op6_html_extraction,
    op7_language_id,
    op8_decontamination,
    op9_toxicity,
    op10_license_scan,
    op11_line_dedup,
    op12_periodic_runs,
    op13_fill_in_middle,
)


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op8_decontamination": OP8_SQL, "op10_license_scan": OP10_SQL, "op11_line_dedup": OP11_SQL, "op13_fill_in_middle": OP13_SQL}


OP2_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""

OP8_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bwin AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bwin),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, n FROM dwin JOIN bwin USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11_SQL = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d),
formed AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

_QUOTED = [(name, text.replace("'", "''")) for name, text in TEMPLATES]
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(string_split_regex({_ASCII}, '[^a-z0-9]+'), lambda w: w <> '')"
_JOINED = r"trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g'))"
OP10_SQL = rf"""
WITH templates(template, license, notice) AS (VALUES {", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(_QUOTED))}),
files AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 1000 = 0 THEN '/corpus/' || doc_id // 1000 || '/LICENSE' WHEN doc_id % 50 = 0 THEN '/corpus/' || doc_id // 1000 || '/' || doc_id // 50 || '/LICENSE'
    ELSE '/corpus/' || doc_id // 1000 || '/' || doc_id // 50 || '/' || doc_id || '.txt' END AS path FROM documents
), speaking AS (SELECT * FROM files WHERE regexp_matches(text, '(?i)(?:{SPEAKS})')),
blocks AS (SELECT doc_id, {_JOINED.format("part")} AS notice FROM (SELECT doc_id, unnest(string_split_regex(text, '\n[ \t\r]*\n')) AS part FROM speaking)),
lines AS (SELECT doc_id, {_JOINED.format("part")} AS notice FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM speaking)),
sentences AS (SELECT doc_id, unnest(string_split(regexp_replace(notice, '([.;!?]) ', '\1' || chr(10), 'g'), chr(10))) AS notice FROM (SELECT * FROM lines UNION ALL SELECT * FROM blocks)),
said AS (
  SELECT DISTINCT doc_id, notice FROM (SELECT * FROM blocks UNION ALL SELECT * FROM sentences UNION ALL SELECT doc_id, {_JOINED.format("text")} FROM speaking WHERE regexp_matches(path, '/LICENSE$'))
  WHERE regexp_matches(notice, '(?i)(?:{SPEAKS})')
), units AS (SELECT notice, count(*) AS n FROM said GROUP BY notice),
everything AS (SELECT notice, n FROM units UNION ALL SELECT notice, 1 FROM templates),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM everything),
idf AS (SELECT word, ln((1 + any_value(total.n)) / (1 + sum(e.n))) + 1 AS idf FROM (SELECT n, unnest(list_distinct({_WORDS.format("notice")})) AS word FROM everything) e, total GROUP BY word),
own AS (SELECT notice, word, count(*) * any_value(idf) AS weight FROM (SELECT notice, unnest({_WORDS.format("notice")}) AS word FROM units) JOIN idf USING (word) GROUP BY notice, word),
theirs AS (SELECT template, license, word, count(*) * any_value(idf) AS weight FROM (SELECT template, license, unnest({_WORDS.format("notice")}) AS word FROM templates) JOIN idf USING (word) GROUP BY template, license, word),
own_norms AS (SELECT notice, sqrt(sum(weight * weight)) AS norm FROM own GROUP BY notice),
their_norms AS (SELECT template, sqrt(sum(weight * weight)) AS norm FROM theirs GROUP BY template),
scored AS (
  SELECT notice, license, round(sum(own.weight * theirs.weight) / (any_value(own_norms.norm) * any_value(their_norms.norm)), 6) AS score
  FROM own JOIN theirs USING (word) JOIN own_norms USING (notice) JOIN their_norms USING (template) GROUP BY notice, template, license
), known AS (SELECT notice, license, score FROM (SELECT *, row_number() OVER (PARTITION BY notice ORDER BY score DESC, license) AS k FROM scored WHERE score >= 0.7) WHERE k = 1),
best AS (SELECT doc_id, license AS own_license, score AS own_score FROM (SELECT doc_id, license, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS k FROM said JOIN known USING (notice)) WHERE k = 1),
found AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own_license, own_score FROM files LEFT JOIN best USING (doc_id)),
licensed AS (SELECT dir AS above, own_license AS dir_license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) AS k FROM found WHERE own_license IS NOT NULL AND regexp_matches(path, '/LICENSE$')) WHERE k = 1),
near AS (SELECT dir, above, dir_license FROM (SELECT d.dir, l.above, l.dir_license, row_number() OVER (PARTITION BY d.dir ORDER BY length(l.above) DESC) AS k FROM (SELECT DISTINCT dir FROM found) d JOIN licensed l ON d.dir = l.above OR starts_with(d.dir, l.above || '/')) WHERE k = 1)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN above END AS from_dir FROM found LEFT JOIN near USING (dir)
"""
