"""One query for each corpus operator over whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to a content-addressed store and read back."""
    import public_tokenizers

    from tidemill.llm.token_store import stored_documents

    return stored_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def _piece_columns(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    from tidemill.llm.pieces import sampled_pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = sampled_pieces(docs, model, k=2, decode=True)
    return found.select(
        "doc_id", "rank", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), "log_probability", "inclusion", "log_inclusion"
    )


def op2_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, and the crc32 of what each decodes to."""
    return _piece_columns(_documents(spark, sf_dir))


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item of which half or more is tiled in the document."""
    from tidemill.llm.decontaminate import leaks

    found = leaks(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*").withColumn("coverage", F.col("matched") / F.col("words"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules for all documents."""
    from tidemill.llm.quality_rules import judged

    return judged(_documents(spark, sf_dir), _labels(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def op5_two_pass_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the two-pass shuffle; shard sizes in rows differ by one at most."""
    from tidemill.llm.shards import shuffled_shards

    shards = shuffled_shards(_documents(spark, sf_dir), shards=16)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _pii_columns(found: DataFrame) -> DataFrame:
    from tidemill.llm.pii import KINDS, joined

    spans = F.concat("base", "added")

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op8_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents by the base patterns and by bootstrapped contexts."""
    from tidemill.llm.pii import find_pii

    return _pii_columns(find_pii(_documents(spark, sf_dir)))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the field over lines."""
    from tidemill.llm.line_crf import scored

    return scored(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by the recurrent network."""
    from tidemill.llm.toxicity import held_out_scores

    return held_out_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the 4-word-shingle Jaccard join at 0.85 over all documents."""
    from tidemill.llm.ngram_join import ngram_components

    return ngram_components(_documents(spark, sf_dir), width=4, num=85, den=100)


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the hierarchical Pitman-Yor model, beside add-0.1 unigram scores."""
    from tidemill.llm.pitman_yor import scored

    return scored(_documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of each benchmark item, by bounds from bit-sliced signatures."""
    from tidemill.llm.lexical_search import search

    return search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) SEMI JOIN asked USING (term) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l)))) AS part FROM tf JOIN sized USING (r) JOIN weight USING (term), total),
scored AS (SELECT q, item_id, r, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN part USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10"""


def op12_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language, over all documents."""
    from tidemill.llm.collocations import collocations

    return collocations(_documents(spark, sf_dir), least=100, top=2_000)


OP12_SQL = f"""
WITH piece AS (SELECT lang, row_number() OVER () AS p, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
size AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM piece GROUP BY lang),
window_ AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3, 4, 5]) AS k))),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM window_ GROUP BY lang, k, phrase HAVING count(*) >= 100),
inner_ AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, a, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM f WHERE k > 2)) GROUP BY ALL),
cut AS (SELECT lang, phrase, a, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:], ' ') AS tail FROM (SELECT f.*, unnest(range(1, k)) AS c
  FROM f LEFT JOIN inner_ USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR longer < a))),
scored AS (SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, n, c, CAST((1000::HUGEINT * cut.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = head JOIN f r ON r.lang = cut.lang AND r.phrase = tail JOIN size ON size.lang = cut.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) WHERE rank <= 2000"""


OP6_SQL = f"""WITH RECURSIVE
word AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t-\\r]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS runs FROM word),
run AS (SELECT doc_id, unnest(runs) AS run FROM sets),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM run x JOIN run y ON x.run = y.run AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * common >= 85 * (len(x.runs) + len(y.runs) - common)),
reach AS (SELECT a AS node, a AS seen FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen)
SELECT doc_id, CAST(len(runs) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(n, 0) AS n_links FROM sets
LEFT JOIN (SELECT node AS doc_id, min(seen) AS component FROM reach GROUP BY node) USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a) USING (doc_id)"""


def op13_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that differ in at most four bits."""
    from tidemill.llm.simhash import near_copies

    return near_copies(_documents(spark, sf_dir), width=4, radius=4)


QUERIES = {"op1_token_store": op1_token_store, "op2_gumbel_pieces": op2_gumbel_pieces, "op3_string_tiling": op3_string_tiling, "op4_quality_rules": op4_quality_rules, "op5_two_pass_shards": op5_two_pass_shards, "op6_ngram_join": op6_ngram_join, "op7_toxicity": op7_toxicity, "op8_context_pii": op8_context_pii, "op9_line_crf": op9_line_crf, "op10_pitman_yor": op10_pitman_yor, "op11_lexical_search": op11_lexical_search, "op12_phrase_tries": op12_phrase_tries, "op13_simhash_trees": op13_simhash_trees}
ORACLES: dict[str, str] = {"op6_ngram_join": OP6_SQL, "op11_lexical_search": OP11_SQL, "op12_phrase_tries": OP12_SQL}
