"""The registered queries of the numbered operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from brindle.llm import ann, bpe, html_text, importance, mixing, near_dedup, pii, quality, suffix_dedup, toxicity, url_rules, vector_codes, warc
from brindle.llm.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_ids(_table(spark, sf_dir, "documents"))
    base = lambda kind: F.size(F.filter("_spans", lambda x: (x["kind"] == kind) & x["base"])).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[base(k) for k in pii.KINDS],
        F.sha2(pii.listed(F.col("_spans"), True).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("_spans"), False).alias("spans"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.digests(bpe.encode(docs, path).drop("text"), path)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_ids(_table(spark, sf_dir, "documents"))
    base = [f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *base, "base_failed", "kept", "p_good")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archives = scratch.path("archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), archives)
    records = scratch.save(warc.read_records(spark, archives, payloads=False), "records")
    captures = warc.assemble(records)
    return captures.select(
        F.expr("try_cast(metadata['key'] as bigint)").alias("page_id"),
        F.coalesce("response.payload_bytes", "origin.bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "origin.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.expr("try_cast(origin.fields['key'] as bigint)").alias("refers_to"),
        "digest_fits",
    )


#: The rules that the contract names, as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out, "score", "predicted")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, _table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vector_codes.compress(vectors).drop("label")


def _codes_sql(rounds: int = vector_codes.ROUNDS, parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES) -> str:
    nearest = """SELECT vec_id, p, min({{'d': x.s - 2 * list_inner_product(x.q, b.q) + list_inner_product(b.q, b.q), 'e': b.e}}) AS best
            FROM parts x JOIN book{r} b USING (p) GROUP BY vec_id, p"""
    steps = [
        f"""near{r} AS MATERIALIZED ({nearest.format(r=r)}),
        moved{r} AS (
            SELECT p, e, list(m::DOUBLE ORDER BY i) AS q FROM (
                SELECT p, best.e AS e, i, floor(sum(q[i + 1]) / count(*)) AS m FROM near{r} JOIN parts USING (vec_id, p), range(64 // {parts}) t(i) GROUP BY ALL
            ) GROUP BY p, e
        ),
        book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.q, b.q) AS q FROM book{r} b LEFT JOIN moved{r} m USING (p, e)),"""
        for r in range(rounds)
    ]
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        cut AS (SELECT vec_id, p, v[p * 64 // {parts} + 1 : (p + 1) * 64 // {parts}] AS q FROM kept, range({parts}) t(p)),
        parts AS MATERIALIZED (SELECT *, list_inner_product(q, q) AS s FROM cut),
        book0 AS MATERIALIZED (
            SELECT p, e, q FROM (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {entries}
        ),
        {" ".join(steps)}
        last AS ({nearest.format(r=rounds)}),
        coded AS (
            SELECT vec_id, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY vec_id
        ),
        digest AS (
            SELECT sha256(string_agg(array_to_string(list_transform(q, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id), digest"""


_RESAMPLING_SQL = r"""
        WITH steps AS (
            SELECT list(list_reduce([i] || range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab
            FROM range(256) t(i)
        ),
        words AS MATERIALIZED (
            SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w
            FROM (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)
        ),
        coded AS MATERIALIZED (
            SELECT w, xor(list_reduce([4294967295] || list_transform(range(0, len(h), 2), lambda k:
                       (instr('0123456789ABCDEF', h[k + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[k + 2]) - 1),
                       lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT w, hex(encode(w)) AS h FROM words GROUP BY w), steps
        ),
        counted AS (
            SELECT bucket, count(*) FILTER (side = 't') AS t, count(*) FILTER (side = 's') AS s FROM words JOIN coded USING (w) GROUP BY bucket
        ),
        gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain
            FROM counted
        ),
        weights AS (
            SELECT id, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM words JOIN coded USING (w) JOIN gains USING (bucket)
            WHERE side = 's' GROUP BY id
        ),
        scored AS (
            SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM documents LEFT JOIN weights ON doc_id = id
        ),
        ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS draws FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= draws THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_nearest": op5_nearest,
    "op6_warc": op6_warc,
    "op7_url_filters": op7_url_filters,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_html_text": op11_html_text,
    "op12_resampling": op12_resampling,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op12_resampling": _RESAMPLING_SQL,
    "op13_vector_codes": _codes_sql(),
    "op7_url_filters": f"""
        WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        parts AS (
            SELECT page_id, path,
                   translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
            FROM (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS host,
                         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        ),
        judged AS (
            SELECT page_id, host, path,
                   (SELECT arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) FROM rules r
                    WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best
            FROM parts p
        )
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged""",
}
