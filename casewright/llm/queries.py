"""The queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stage
from .class_lm import score
from .conversation_trie import conversation_trie
from .curriculum import mixing_table
from .decontaminate import leaks
from .embedding_dedup import near_duplicates
from .html_text import extract_pages
from .importance import importance_sample
from .jaccard_join import ngram_jaccard_join
from .lexical_search import ranked_search
from .licenses import license_digest, license_spans
from .line_dedup import line_repeats
from .paragraph_dedup import paragraph_repeats
from .token_files import read_documents, write_token_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the size of their shingle set and the component of links at 75 percent."""
    return ngram_jaccard_join(table(spark, folder, "documents"))


OP4 = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM totals),
weighed AS (SELECT *, [3.0, 1.0, 2.0][1 + i % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
filled AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS below, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM weighed WINDOW w AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (1.5 * (SELECT sum(size) FROM sized) - below) / rest AS level FROM filled),
lift AS (SELECT arg_min(level, cap / weight) FILTER (level <= cap / weight) AS level FROM levels),
facts AS (SELECT weighed.*, least(cap, weight * level) AS target FROM weighed, lift),
placed AS (SELECT doc_id, size, source_size, target, i, floor(target + 0.5)::BIGINT AS goal,
  sum(size) OVER (PARTITION BY i ORDER BY md5('mix' || doc_id::VARCHAR)) - size AS start
  FROM sized JOIN facts ON sized.source IS NOT DISTINCT FROM facts.source),
spans AS (SELECT *, greatest(0, least(size, goal - start)) AS t1, greatest(0, least(size, goal - start - source_size)) AS t2 FROM placed),
shares AS (SELECT *, (start + t1 / 2) / greatest(goal, 1) AS u1, (start + source_size + t2 / 2) / greatest(goal, 1) AS u2,
  [-1.0, 0.0, 1.0][1 + i % 3]::DOUBLE AS slope, [1.5, 1.0, 0.5][1 + i % 3]::DOUBLE AS w0 FROM spans)
SELECT doc_id, size, source_size, round(target, 3) AS target, (t1 + t2)::BIGINT AS taken,
  CASE WHEN t1 > 0 THEN round(2 * u1 / (w0 + sqrt(greatest(0, w0 * w0 + 2 * slope * u1))), 6) END AS position_1,
  CASE WHEN t2 > 0 THEN round(2 * u2 / (w0 + sqrt(greatest(0, w0 * w0 + 2 * slope * u2))), 6) END AS position_2
FROM shares"""


@query
def op4_curriculum_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document by the curriculum, with its positions in training time."""
    rows = mixing_table(table(spark, folder, "documents"))
    return rows.withColumns({"target": F.round("target", 3), **{p: F.round(p, 6) for p in ("position_1", "position_2")}})


ORACLES["op4_curriculum_mixing"] = OP4.strip()


@query
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that importance resampling keeps, with their log weights."""
    sample = importance_sample(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return sample.where("kept").select("doc_id", "log_weight", "noisy")


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write token files of ``docs`` to the shared folder and digest what is read back."""
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer)
    back = read_documents(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
    return stage(back, "token-digest")


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read from the token files."""
    return token_digest(spark, table(spark, folder, "documents"), tokenizer_path())


@query
def op1_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that occur in several documents, with what is removed."""
    return paragraph_repeats(table(spark, folder, "documents"))


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that match an earlier line at 80 percent, with the earliest match."""
    return line_repeats(table(spark, folder, "documents"))


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item at 75 percent or more, with the best window."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("tk")


@query
def op3_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under word counts and under the class bigram model."""
    return score(table(spark, folder, "documents"))


@query
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, folder, "pages"))


@query
def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of the vectors of one label at a cosine of 0.98."""
    return near_duplicates(table(spark, folder, "embeddings"))


@query
def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and templates found in every document."""
    return license_digest(license_spans(table(spark, folder, "documents")))


OP12 = """
WITH turns AS (SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv, conv - conv % 20 AS head, count(*) AS own, xor(4294967295, list_reduce(list_transform(string_split(conv::VARCHAR, ''),
    lambda s: ascii(s)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295)) % 4 AS h
  FROM turns GROUP BY conv),
rebuilt AS (SELECT c.conv, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.head AND t.place <= c.h
  UNION ALL SELECT c.conv, t.place - c.h + least(c.h, coalesce(f.own, 0)), t.role, t.text FROM convs c JOIN turns t ON t.conv = c.conv AND t.place > c.h
    LEFT JOIN convs f ON f.conv = c.head),
prefixes AS (SELECT conv, place AS depth, list(md5(role) || md5(text)) OVER (PARTITION BY conv ORDER BY place) AS path,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM rebuilt
  UNION ALL SELECT conv, 0, [], 0 FROM convs),
members AS (SELECT *, min(conv) OVER (PARTITION BY path) AS node, max(depth) OVER (PARTITION BY conv) AS last FROM prefixes),
nodes AS (SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (depth = last), '')) AS ends_sha256 FROM members GROUP BY node, depth),
parents AS (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.conv = n.node AND m.depth = n.depth - 1),
kids AS (SELECT p.node, p.depth, count(c.node) AS n_children FROM nodes p LEFT JOIN parents c ON c.parent = p.node AND c.depth = p.depth + 1 GROUP BY ALL),
totals AS (SELECT m.node, m.depth, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM nodes n JOIN kids k ON k.node = n.node AND k.depth = n.depth JOIN members m ON m.conv = n.node AND m.depth <= n.depth GROUP BY ALL)
SELECT n.node AS conv_id, n.depth, n.parent AS parent_conv_id, n.n_convs, k.n_children, t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM parents n JOIN kids k ON k.node = n.node AND k.depth = n.depth JOIN totals t ON t.node = n.node AND t.depth = n.depth"""


@query
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every prefix of the rebuilt conversations with its members, children and subtree totals."""
    return conversation_trie(table(spark, folder, "conversations"))


ORACLES["op12_conversation_trie"] = OP12.strip()


OP13 = """
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
sized AS (SELECT row_number() OVER () AS d, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
counts AS (SELECT d, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, totals GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY item_id, d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 documents that match every benchmark item best."""
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op13_ranked_search"] = OP13.strip()


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Token digest of the corpus after all stages of the pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
