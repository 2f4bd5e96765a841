"""One query per operator over the test tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, listed from the files."""
    import public_tokenizers

    from sievework.llm.token_store import token_store

    return token_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@register
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document by trees fitted on the labels."""
    from sievework.llm.quality_rules import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))


@register
def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from sievework.llm.dart_minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@register
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from sievework.llm.extract import main_text

    return main_text(_table(spark, sf_dir, "pages"))


# The rules of the query's contract (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@register
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url."""
    from sievework.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def _sql_rules(what: str, host: str, path: str) -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    cases = " ".join(
        f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{h + p if what == 'rule' else v}'"
        for v, h, p in ordered
    )
    return f"CASE {cases} END"


def _sql_url(url: str) -> str:
    """Columns host, path and resource of a url."""
    part = r"'(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)'"
    host = f"translate(coalesce(regexp_extract({url}, {part}, 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"coalesce(regexp_extract({url}, {part}, 2), '')"
    key = f"CASE WHEN {host} != '' THEN {host} || {path} || regexp_extract({url}, {part}, 3) END"
    return f"{host} AS host, {path} AS path, {key} AS resource"


# The test pages hold absolute links only, so the SQL resolves no relative ones.
_WS = "[\\t\\n\\f\\r ]"
_SQL_ATTRIBUTES = rf"""(?:[^>=]|={_WS}*"[^"]*"|={_WS}*'[^']*'|=)*"""
_SQL_PLAIN = "|".join(
    rf"<{name}(?:[\t\n\f\r /]{_SQL_ATTRIBUTES})?(?:>.*?(?:</{name}[\t\n\f\r />]|\z)|\z)"
    for name in ("script", "style", "textarea", "title", "iframe", "xmp")
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SQL_MARKUP = _quoted(rf"(?is)<!--(?:>|->|.*?(?:-->|--!>|\z))|{_SQL_PLAIN}|</?[a-z]{_SQL_ATTRIBUTES}(?:>|\z)")
_SQL_ATTRIBUTE = _quoted(rf"""(?s)[^\t\n\f\r />=]+{_WS}*={_WS}*(?:"[^"]*"|'[^']*'|[^\t\n\f\r >]+)|[^\t\n\f\r />=]+""")


def _sql_value(text: str, pattern: str) -> str:
    return " || ".join(f"regexp_extract({text}, {_quoted(pattern)}, {k})" for k in (1, 2, 3))


def _sql_attribute(name: str) -> str:
    """Value of the first attribute of this name of a tag."""
    value = _sql_value("attribute", rf"""(?s)^[^=]*={_WS}*(?:"([^"]*)"|'([^']*)'|(.*))$""")
    return f"arg_min({value}, place) FILTER (regexp_matches(attribute, '(?i)^{name}{_WS}*='))"


_SQL_REFRESH = _sql_value(
    "content", rf"""(?is)^{_WS}*[0-9.]+{_WS}*[;,]?{_WS}*(?:url{_WS}*={_WS}*)?(?:"([^"]*).*|'([^']*).*|(.*))$"""
)
ORACLE["op10_url_filter"] = f"""
WITH RECURSIVE page AS (SELECT page_id, url, html, {_sql_url("url")} FROM pages),
tag AS (SELECT a, tag, row_number() OVER () AS tag_no FROM (
    SELECT resource AS a, unnest(regexp_extract_all(html, {_SQL_MARKUP})) AS tag FROM page)
  WHERE regexp_matches(tag, '(?is)^<(?:link|meta)[\\t\\n\\f\\r /].*>$')),
named AS (SELECT a, tag, tag_no, unnest(attributes) AS attribute, generate_subscripts(attributes, 1) AS place FROM (
  SELECT a, tag, tag_no, regexp_extract_all(regexp_replace(tag, '(?s)^<[A-Za-z]+|>$', '', 'g'), {_SQL_ATTRIBUTE}) AS attributes FROM tag)),
meant AS (
  SELECT a, tag, {_sql_attribute("rel")} AS rel, {_sql_attribute("href")} AS href,
    {_sql_attribute("http-equiv")} AS equiv, {_sql_attribute("content")} AS content
  FROM named GROUP BY a, tag, tag_no),
link AS (
  SELECT a, replace(trim(href), '&amp;', '&') AS url FROM meant
  WHERE regexp_matches(tag, '(?i)^<link') AND regexp_matches(rel, '(?i)(?:^|{_WS})canonical(?:{_WS}|$)')
  UNION ALL SELECT a, replace(trim({_SQL_REFRESH}), '&amp;', '&') FROM meant
  WHERE regexp_matches(tag, '(?i)^<meta') AND regexp_matches(equiv, '(?i)^refresh$')),
edge AS (SELECT a, b FROM (SELECT a, resource AS b FROM (SELECT a, {_sql_url("url")} FROM link WHERE url != ''))
  WHERE a IS NOT NULL AND b IS NOT NULL),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
node AS (SELECT a AS resource, {_sql_url("'x://' || a")[: -len(" AS resource")]} AS again FROM (SELECT DISTINCT a FROM both_ways)),
spread AS (
  SELECT resource FROM node WHERE {_sql_rules("verdict", "host", "path")} = 'block'
  UNION SELECT both_ways.b FROM spread JOIN both_ways ON spread.resource = both_ways.a)
SELECT page_id, host, path, {_sql_rules("rule", "host", "path")} AS rule,
  coalesce({_sql_rules("verdict", "host", "path")},
    CASE WHEN resource IN (SELECT resource FROM spread WHERE resource IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM page
"""


@register
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that are no snapshot of a longer one, rendered."""
    from sievework.llm.chat import maximal_conversations, render

    return render(maximal_conversations(_table(spark, sf_dir, "conversations")))


ORACLE["op3_chat_format"] = """
WITH turn AS (
  SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role IS NULL, coalesce(role, ''), text IS NULL, coalesce(text, '')) - 1 AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
conv AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns, any_value(text) FILTER (pos = 0) AS head FROM turn GROUP BY conv_id),
gone AS (
  SELECT DISTINCT a.conv_id FROM conv a JOIN conv b ON a.head IS NOT DISTINCT FROM b.head AND a.conv_id != b.conv_id
    AND len(a.turns) <= len(b.turns) AND a.turns = b.turns[1:len(a.turns)]
    AND (len(a.turns) < len(b.turns) OR a.conv_id > b.conv_id))
SELECT conv_id, CAST(pos // 256 AS BIGINT) AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10)
    || replace(replace(coalesce(text, ''), '<|im_start|>', '\\<|im_start|>'), '<|im_end|>', '\\<|im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM turn WHERE conv_id NOT IN (SELECT conv_id FROM gone) GROUP BY conv_id, pos // 256
"""


@register
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    from sievework.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# Every window that shares a shingle with an item, compared exactly.
ORACLE["op2_decontaminate"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
d AS (SELECT doc_id, len(w) - 4 AS doc_n, unnest(range(len(w) - 4)) AS pos, w FROM dw WHERE len(w) >= 5),
ds AS (SELECT doc_id, doc_n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS s FROM d),
i AS (SELECT item_id, len(w) - 4 AS n, unnest(range(len(w) - 4)) AS pos, w FROM iw WHERE len(w) >= 5),
its AS (SELECT item_id, n, array_to_string(w[pos + 1:pos + 5], ' ') AS s, count(*) AS c FROM i GROUP BY 1, 2, 3),
hit AS (SELECT doc_id, doc_n, item_id, n, pos FROM ds JOIN its USING (s)),
win AS (SELECT DISTINCT doc_id, item_id, n,
  unnest(range(least(greatest(pos - n + 1, 0), greatest(doc_n - n, 0)), least(pos, greatest(doc_n - n, 0)) + 1)) AS start FROM hit),
cnt AS (SELECT win.doc_id, item_id, n, start, s, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.pos BETWEEN start AND start + n - 1
  GROUP BY 1, 2, 3, 4, 5),
sim AS (SELECT cnt.doc_id, cnt.item_id, start, cnt.n, sum(cnt.c) AS m, sum(least(cnt.c, coalesce(its.c, 0))) AS both_c
  FROM cnt LEFT JOIN its ON cnt.item_id = its.item_id AND cnt.s = its.s GROUP BY 1, 2, 3, 4),
ok AS (SELECT doc_id, item_id, start, CAST(both_c AS DOUBLE) / CAST(m + n - both_c AS DOUBLE) AS similarity FROM sim)
SELECT doc_id, item_id, start, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM ok WHERE similarity >= 0.8) WHERE r = 1
"""


@register
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, digested, and whether they decode to the text."""
    import public_tokenizers

    from sievework.llm.piece_lattice import encoding_digests

    return encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register
def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document."""
    from sievework.llm.pseudo_lm import word_likelihood

    return word_likelihood(_table(spark, sf_dir, "documents"))


@register
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from, and left of, every document."""
    from sievework.llm.suffix_dedup import dedup_spans

    return dedup_spans(_table(spark, sf_dir, "documents"))


@register
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between byte-level and SentencePiece ids of every document, with corpus-wide counts."""
    import public_tokenizers

    from sievework.llm.alignment import align_tokens

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align_tokens(_table(spark, sf_dir, "documents"), *paths)


@register
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and what is left of it without lines that many documents share."""
    from sievework.llm.line_dedup import dropped_line_digests

    return dropped_line_digests(_table(spark, sf_dir, "documents"))


ORACLE["op11_line_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, line, pos, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@register
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, after every seventh label has been moved on."""
    from sievework.llm.hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), "id % 50 = 0")


ORACLE["op12_hard_negatives"] = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id != b.id WHERE a.id % 50 = 0),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3
"""
