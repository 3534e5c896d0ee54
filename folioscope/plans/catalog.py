"""Every registered query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import profiles
from folioscope.operators import canonical, documents, neighbours
from folioscope.operators import tokens as tk
from folioscope.plans.dialect import DUCK, SPARK, Dialect
from folioscope.plans import queries_corpus, queries_relational, queries_structure, queries_style, queries_text

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_STOP = queries_corpus.canonical_stop()


def _sql(df: DataFrame, build: Callable[..., str], *more) -> DataFrame:
    """A query of operators.canonical over one DataFrame."""
    sql = build(SPARK, "@x@", *more).replace("{", "{{").replace("}", "}}").replace("@x@", "{x}")
    return df.sparkSession.sql(sql, x=df)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts that come in fewer splits than there are cores are dealt out first; large tables have more and are not."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def _refs(read: Callable) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("doc_id"), "text")


def _blocks(read: Callable) -> DataFrame:
    return _sql(tk.paragraphs(read("documents")), canonical.blocks)


def _stream(read: Callable) -> DataFrame:
    return _sql(_blocks(read), canonical.stream)


def _passages(read: Callable) -> DataFrame:
    return tk.shingles(_sql(tk.paragraphs(read("documents")), canonical.words, "doc_id, idx"), _STOP, ("doc_id", "idx"), longer=0)


def _reference(read: Callable) -> DataFrame:
    return _sql(_refs(read), canonical.words, "doc_id")


#: Base tables as Spark builds them.
BASES: dict[str, Callable] = {
    "para": lambda read: tk.paragraphs(read("documents")),
    "tok": lambda read: tk.tokens(read("documents")),
    "ptok": lambda read: tk.paragraph_tokens(read("documents")),
    "sent": lambda read: tk.sentences(read("documents")),
    "blk": _blocks,
    "ctok": _stream,
    "cptok": lambda read: _sql(tk.paragraphs(read("documents")), canonical.words, "doc_id, idx"),
    "sh": lambda read: tk.shingles(_stream(read), _STOP),
    "fp": lambda read: tk.winnow(tk.shingles(_stream(read), _STOP)),
    "psh": _passages,
    "pfp": lambda read: tk.winnow(_passages(read), ("doc_id", "idx")).select("doc_id", "idx", "h").distinct(),
    "rtok": _reference,
    "rsh": lambda read: tk.shingles(_reference(read), _STOP),
    "rfp": lambda read: tk.winnow(tk.shingles(_reference(read), _STOP)),
}


def _ctes() -> dict[str, str]:
    """The same base tables in DuckDB."""
    word, cut = DUCK.lit(profiles.WORD), DUCK.lit(profiles.SENTENCE_END)

    def tok(source: str, key: str) -> str:
        return f"SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT {key}, regexp_extract_all(lower(text), {word}) AS w FROM {source})"

    def sh(source: str, key: str, stop: list[str], longer: int = 1) -> str:
        among = ", ".join(DUCK.lit(w) for w in stop)
        leads = ", ".join(f"lead(word, {i}) OVER w AS w{i}" for i in range(1, 6))
        return f"""SELECT {key}, pos, {DUCK.h60("concat_ws(' ', word, w1, w2, w3, w4, w5)")} AS h FROM (
            SELECT {key}, pos, word, {leads}, sum(CASE WHEN word NOT IN ({among}) AND length(word) > {longer} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS content
            FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE w5 IS NOT NULL AND content >= 2"""

    def fp(source: str, key: str = "doc_id") -> str:
        return f"""SELECT DISTINCT {key}, pos, h FROM (
            SELECT {key}, CASE WHEN n <= 4 THEN pos ELSE -least.p END AS pos, CASE WHEN n <= 4 THEN h ELSE least.h END AS h FROM (
            SELECT {key}, pos, h, count(*) OVER (PARTITION BY {key}) AS n, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS i,
                   min({{'h': h, 'p': -pos}}) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS least FROM {source})
            WHERE n <= 4 OR i <= n - 3)"""

    refs = "(SELECT item_id AS doc_id, text FROM benchmark)"
    para = "SELECT doc_id, idx, trim(text) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents) WHERE trim(text) <> ''"
    sent = f"SELECT doc_id, idx, n, sentence FROM (SELECT doc_id, idx, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS n FROM (SELECT doc_id, idx, string_split(regexp_replace(text, {cut}, '\\1' || chr(30) || '\\2', 'g'), chr(30)) AS s FROM para)) WHERE regexp_matches(sentence, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')"
    return {
        "para": para,
        "tok": tok("documents", "doc_id"),
        "ptok": tok("para", "doc_id, idx"),
        "sent": sent,
        "blk": canonical.blocks(DUCK, "para"),
        "ctok": canonical.stream(DUCK, "blk"),
        "cptok": canonical.words(DUCK, "para", "doc_id, idx"),
        "sh": sh("ctok", "doc_id", _STOP),
        "fp": fp("sh"),
        "psh": sh("cptok", "doc_id, idx", _STOP, 0),
        "pfp": f"SELECT DISTINCT doc_id, idx, h FROM ({fp('psh', 'doc_id, idx')})",
        "rtok": canonical.words(DUCK, refs, "doc_id"),
        "rsh": sh("rtok", "doc_id", _STOP),
        "rfp": fp("rsh"),
    }


_NEEDS = {"ptok": ["para"], "sent": ["para"], "blk": ["para"], "ctok": ["para", "blk"], "cptok": ["para"], "sh": ["para", "blk", "ctok"], "fp": ["para", "blk", "ctok", "sh"], "psh": ["para", "cptok"], "pfp": ["para", "cptok", "psh"], "rsh": ["rtok"], "rfp": ["rtok", "rsh"]}


def _spark_query(bases: tuple[str, ...], build: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    sql = build(SPARK)

    def run(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
        """given: DataFrames that stand for tables."""

        def read(name: str) -> DataFrame:
            return given[name] if name in given else _read(spark, sf_dir, name)

        for name in TABLES:
            if SPARK.t(name) in sql:
                read(name).createOrReplaceTempView(SPARK.t(name))
        for base in bases:
            BASES[base](read).createOrReplaceTempView(SPARK.t(base))
        return spark.sql(sql)

    return run


def by_document(query: Callable, within: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, whose results are each of one doc_id: by within(docs) where one row has that doc_id, by its SQL where several have."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _read(spark, sf_dir, "documents")
        repeated = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again"))
        if repeated.isEmpty():
            return within(docs)
        several = F.col("doc_id").eqNullSafe(F.col("again"))
        return within(docs.join(repeated, several, "left_anti")).unionByName(query(spark, sf_dir, documents=docs.join(repeated, several, "left_semi")))

    return run


def _duck_query(bases: tuple[str, ...], build: Callable[[Dialect], str]) -> str:
    ctes, order = _ctes(), list(dict.fromkeys(x for b in bases for x in [*_NEEDS.get(b, []), b]))
    sql = build(DUCK).strip()
    if not order:
        return sql
    head = ",\n".join(f"{b} AS ({ctes[b]})" for b in order)
    return f"WITH {head},\n{sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head}\n{sql}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_corpus, queries_relational, queries_structure, queries_style, queries_text):
    for _name, (_bases, _build) in _module.SHARED.items():
        QUERIES[_name] = _spark_query(_bases, _build)
        ORACLE_SQL[_name] = _duck_query(_bases, _build)
    QUERIES |= getattr(_module, "QUERIES", {})
    ORACLE_SQL |= getattr(_module, "ORACLE_SQL", {})

#: Queries that Spark answers in another way than by that SQL.
QUERIES["h8_repeated_phrases"] = by_document(QUERIES["h8_repeated_phrases"], lambda docs: documents.repeated_phrases(docs, _STOP, range(5, 10), 3, 3))
QUERIES["h1_shingles"] = by_document(QUERIES["h1_shingles"], lambda docs: documents.shingle_summary(docs, _STOP))
QUERIES["i1_hash_embedding"] = by_document(QUERIES["i1_hash_embedding"], documents.hash_embedding)


def _cosine_neighbours(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Exact tiles; by the SQL, pair by pair, where a vector is null, empty, or holds null components, or a length of zero."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = _read(spark, sf_dir, "embeddings")
        odd = F.col("embedding").isNull() | F.exists("embedding", lambda v: v.isNull()) | ~F.exists("embedding", lambda v: v != 0) | F.exists("embedding", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
        if not vectors.filter(odd).isEmpty() or vectors.select(F.size("embedding").alias("n")).distinct().count() > 1:
            return query(spark, sf_dir)
        return neighbours.nearest_of_label(vectors)

    return run


QUERIES["i_cosine_neighbours"] = _cosine_neighbours(QUERIES["i_cosine_neighbours"])
