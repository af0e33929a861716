"""Tables, indexes kept for a session, and SQL for what the queries compute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO, Analyzer, word_pattern
from ..sources.index import Index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_indexes: dict[tuple, Index] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Index]) -> Index:
    """The session's index of that name; built at its first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        for old in [k for k in _indexes if k[0] != key[0]]:
            del _indexes[old]
        _indexes[key] = build()
    return _indexes[key]


DOCUMENTS = {"text": "string", "lang": "enum", "source": "string", "n_chars": "number"}


def documents(spark: SparkSession, sf_dir: str, analyzer: Analyzer | None = None, name: str = "documents") -> Index:
    """Text documents; seq is doc_id + 1."""

    def build() -> Index:
        docs = table(spark, sf_dir, "documents").withColumn("seq", F.col("doc_id") + 1)
        # Only text is scored; source is text to sort, group and count by.
        return Index.build(docs, DOCUMENTS, analyzer)

    return kept(spark, sf_dir, name, build)


PARTS = {"p_name": "string", "p_type": "string", "p_brand": "enum", "p_size": "number", "p_retailprice": "number", "words": "enum[]", "sizes": "number[]", "large": "boolean"}


def parts(spark: SparkSession, sf_dir: str) -> Index:
    def build() -> Index:
        p = table(spark, sf_dir, "part").withColumn("seq", F.col("p_partkey") + 1)
        p = p.withColumn("words", F.split("p_name", " ")).withColumn("sizes", F.array("p_size", F.col("p_size") * 2)).withColumn("large", F.col("p_size") > 25)
        return Index.build(p, PARTS)

    return kept(spark, sf_dir, "parts", build)


PARTS_SQL = "docs AS (SELECT p_partkey + 1 AS seq, *, string_split(p_name, ' ') AS words, [p_size, p_size * 2] AS sizes, p_size > 25 AS large FROM part)"
DOCS_SQL = "docs AS (SELECT doc_id + 1 AS seq, * FROM documents)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_sql(text: str, language: str = "english", fold: bool = True) -> str:
    low = f"lower(coalesce({text}, ''))"
    if fold:
        low = f"translate({low}, {quoted(FOLD_FROM)}, {quoted(FOLD_TO)})"
    return f"regexp_extract_all({low}, {quoted(word_pattern(language))})"


def index_sql(props: dict[str, str], docs: str = DOCS_SQL, stop: tuple[str, ...] = (), language: str = "english") -> str:
    """CTEs tf (prop, term, seq, tf), fl (lengths), av (averages), df. props: name -> words' SQL."""
    but = f" WHERE term NOT IN ({', '.join(map(quoted, stop))})" if stop else ""
    each = " UNION ALL ".join(f"SELECT seq, {quoted(p)} AS prop, unnest({w}) AS term FROM docs" for p, w in props.items())
    return f"""{docs}, tok AS (SELECT * FROM ({each}){but}),
tf AS (SELECT prop, term, seq, count(*) AS tf FROM tok GROUP BY ALL), fl AS (SELECT prop, seq, count(*) AS len FROM tok GROUP BY ALL),
n AS (SELECT count(*) AS n FROM docs), av AS (SELECT prop, sum(len) / (SELECT n FROM n) AS av FROM fl GROUP BY prop),
df AS (SELECT prop, term, count(*) AS df FROM tf GROUP BY ALL)"""


def match_sql(mode: str, tolerance: int = 0) -> str:
    if mode == "exact":
        return "d.term = q.token"
    if tolerance:
        return f"(levenshtein(d.term, q.token) <= {tolerance} OR starts_with(d.term, q.token))"
    return "starts_with(d.term, q.token)"


def events_sql(tokens: list[str], props: list[str], mode: str = "prefix", tolerance: int = 0, k: float = 1.2, b: float = 0.75, d: float = 0.5, boost: dict[str, float] | None = None) -> str:
    """CTEs x (expanded words) and ev (seq, prop, i, term, w)."""
    q = ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(tokens))
    boosts = " ".join(f"WHEN {quoted(p)} THEN {v}" for p, v in (boost or {}).items())
    factor = f"CASE tf.prop {boosts} ELSE 1 END" if boosts else "1"
    idf = lambda df: f"ln(1 + (n - {df} + 0.5) / ({df} + 0.5))"
    return f"""q AS (SELECT * FROM (VALUES {q}) v(i, token)),
x AS (SELECT i, token, d.prop, d.term, d.df, {idf('d.df')} AS idf,
  CASE WHEN d.term = q.token THEN 1.0 WHEN o.df IS NULL OR {idf('d.df')} = 0 THEN 0.5 ELSE 0.5 * least(1.0, {idf('o.df')} / {idf('d.df')}) END AS demotion
  FROM q JOIN df d ON {match_sql(mode, tolerance)} LEFT JOIN df o ON o.prop = d.prop AND o.term = q.token CROSS JOIN n WHERE d.prop IN ({', '.join(map(quoted, props))})),
ev AS (SELECT tf.seq, tf.prop, i, x.term, idf * ({d} + tf.tf * ({k} + 1)) / (tf.tf + {k} * (1 - {b} + {b} * len / av)) * demotion * ({factor}) AS w
  FROM x JOIN tf ON tf.prop = x.prop AND tf.term = x.term JOIN fl ON fl.prop = tf.prop AND fl.seq = tf.seq JOIN av ON av.prop = tf.prop)"""


def scores_sql(n: int, threshold: float = 1, allowed: str | None = None) -> str:
    """CTE sc (seq, score) from ev; allowed: SQL condition on docs."""
    kept = f"evk AS (SELECT * FROM ev WHERE seq IN (SELECT seq FROM docs WHERE {allowed}))" if allowed else "evk AS (SELECT * FROM ev)"
    if n == 1 or threshold >= 1:
        return f"{kept}, sc AS (SELECT seq, sum(w) AS score FROM evk GROUP BY seq)"
    if threshold <= 0:
        cover = f"GROUP BY seq, prop HAVING count(DISTINCT i) = {n}"
        return f"""{kept}, sc AS (SELECT seq, sum(w) AS score FROM evk WHERE prop IN (SELECT prop FROM ev {cover})
  AND seq IN (SELECT seq FROM evk {cover}) GROUP BY seq)"""
    return f"""{kept}, fd AS (SELECT seq, prop, count(*) AS c, sum(w) AS w FROM evk GROUP BY ALL), dd AS (SELECT seq, sum(w) AS score, bool_or(c = {n}) AS whole FROM fd GROUP BY seq),
rk AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY round(score, 9) DESC, seq) AS r, count(*) FILTER (NOT whole) OVER () AS np, count(*) FILTER (whole) OVER () AS nf FROM dd),
sc AS (SELECT seq, score FROM rk WHERE whole OR nf = 0 OR r <= ceil({threshold} * np))"""


ORDER = "ORDER BY round(score, 9) DESC, seq"


def text_sql(tokens: list[str], props: dict[str, str] | None = None, select: str = "doc_id, round(score, 6) AS score", limit: int | None = 10, offset: int = 0, docs: str = DOCS_SQL, allowed: str | None = None, threshold: float = 1, stop: tuple[str, ...] = (), **how) -> str:
    props = props or {"text": words_sql("text")}
    page = "" if limit is None else f"{ORDER} LIMIT {limit} OFFSET {offset}"
    return f"WITH {index_sql(props, docs, stop)}, {events_sql(tokens, list(props), **how)}, {scores_sql(len(tokens), threshold, allowed)} SELECT {select} FROM sc JOIN docs USING (seq) {page}"


def scored(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share; a temporary one in local sessions."""
    import tempfile

    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster has to name a folder that its machines share in spark.checkpoint.dir")
    return conf.rstrip("/") if conf else f"file://{tempfile.mkdtemp(prefix='sparkseek-')}"
