"""Queries p2 and p4 to p9."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changegraph.functions import tidy
from changegraph.llm import components, consensus, language, leakage, packing, set_join, term_frequency, tokens
from changegraph.session import Stash
from changegraph.sources.tables import load, load_steps, once


def matched(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "step_matches", "left_step bigint, right_step bigint, is_match boolean").filter("is_match")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.components(spark, matched(spark, d), "left_step", "right_step").select(F.col("vertex").alias("step_no"), F.col("component").alias("group_no"))


def placements(spark: SparkSession, d: str) -> DataFrame:
    """repo, area, endpoint, run_id, flow_id: who places which entry point where; an alias is its inventory endpoint."""
    steps = load_steps(spark, d, "endpoints").select("repo", "area", "run_id", "flow_id", F.explode(tidy.entries("endpoints")).alias("cited"))
    cited = steps.dropna().distinct()
    listed = load(spark, d, "inventory", "repo string, endpoint string, aliases array<string>")
    names = listed.select("repo", F.explode(tidy.entries("aliases")).alias("cited"), tidy.entry("endpoint").alias("named"))
    # a name that is itself an entry point stands for itself; of several owners of an alias the first counts
    own = listed.select("repo", tidy.entry("endpoint").alias("cited"), F.lit(None).cast("string").alias("named"))
    alias = names.unionByName(own).groupBy("repo", "cited").agg(F.min("named").alias("named"), F.max(F.col("named").isNull()).alias("itself")).filter("not itself").drop("itself")
    return cited.join(alias, ["repo", "cited"], "left").select("repo", "area", F.coalesce("named", "cited").alias("endpoint"), "run_id", "flow_id").distinct()


def annotated(spark: SparkSession, d: str) -> consensus.Consensus:
    return consensus.consensus(spark, placements(spark, d), ["repo", "endpoint"], "run_id", "flow_id", ["repo", "area"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).items.filter("votes >= 3 and labels >= 2").select("repo", "endpoint", F.col("label").alias("flow_id"))


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).items.withColumnRenamed("label", "flow_id")


def p4_annotators(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).annotators.withColumnRenamed("annotator", "run_id")


def step_classes(spark: SparkSession, stash: Stash, d: str) -> tuple[DataFrame, DataFrame]:
    steps = load_steps(spark, d, "ui", "code_path")
    return set_join.set_classes(spark, stash, steps, "step_no", F.array_union(tidy.nodes("code_path"), tidy.nodes("ui")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    stash = Stash(spark)
    members, classes = step_classes(spark, stash, d)
    pairs = set_join.similar_classes(spark, stash, classes, 3, 5)
    return set_join.similar_records(members, pairs).select(F.col("record_a").alias("step_a"), F.col("record_b").alias("step_b"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Each step with the class of steps that have the same set, and the number of steps it is similar to."""
    stash = Stash(spark)
    members, classes = step_classes(spark, stash, d)
    pairs = stash.put(set_join.similar_classes(spark, stash, classes, 3, 5))
    return set_join.class_links(members, pairs).withColumnRenamed("record", "step_no")


def node_records(spark: SparkSession, d: str) -> DataFrame:
    """terms: the node ids of each step and each edge, repeats of a record once. A step's or edge's null ids are no values."""
    steps = load_steps(spark, d, "code_path").select("step_no", "code_path").dropDuplicates(["step_no"])
    edges = once(load(spark, d, "graph_edges", "edge_no bigint, src string, dst string"), "edge_no", "src", "dst")
    of_steps = steps.select(F.transform("code_path", tidy.node).alias("terms"))
    return of_steps.unionByName(edges.select(F.array(tidy.node("src"), tidy.node("dst")).alias("terms")))


def count_records(spark: SparkSession, d: str) -> int:
    """Distinct steps and edges, from their numbers alone."""
    steps = load_steps(spark, d).select("step_no").distinct().count()
    return steps + load(spark, d, "graph_edges", "edge_no bigint").distinct().count()


def p6_frequency(spark: SparkSession, d: str) -> DataFrame:
    counted = term_frequency.term_frequency(node_records(spark, d), "terms").withColumnRenamed("term", "node")
    return term_frequency.mark(counted, count_records(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_frequency(spark, d).filter("mark is not null").select("node", "mark")


#: Tokens a container holds, and the rank file of the public tokenizer they are counted with; no such file is part of the repository.
CAPACITY = 4096
VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, piece_no, start, length, container, position: every text, or the pieces of one that is too long, in its container; start and length in tokens."""
    docs = load(spark, d, "documents", "doc_id bigint, text string")
    sizes = Stash(spark).put(tokens.count_tokens(docs, "doc_id", "text", VOCABULARY))
    return packing.pack(spark, sizes, "doc_id", "n_tokens", CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose packing has a second piece."""
    return p7_pack(spark, d).filter("piece_no = 1").select("doc_id").distinct()


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """containers, lower_bound, fill, overfull: how many containers are used, how many any packing needs, the share of their space that is filled, and those over capacity."""
    each = p7_pack(spark, d).filter("container is not null").groupBy("container").agg(F.sum("length").alias("n"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("n") / CAPACITY).alias("lower_bound"), (F.sum("n") / (F.count(F.lit(1)) * CAPACITY)).alias("fill"), F.count(F.when(F.col("n") > CAPACITY, 1)).alias("overfull"))


DOCUMENTS = "doc_id bigint, text string, lang string"


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, item, first_word, last_word, common, coverage: where in a document which item stands, or a long part of it, and how much."""
    items = load(spark, d, "eval_items", "item_id bigint, text string")
    return leakage.find_leaks(load(spark, d, "documents", DOCUMENTS), "doc_id", "text", items, "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).filter(F.col("coverage") >= leakage.COVERAGE).select("doc_id", F.col("item").alias("item_id")).distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold items, without the spans that give them away."""
    found = Stash(spark).put(p8_spans(spark, d))
    return leakage.remove_leaks(load(spark, d, "documents", DOCUMENTS), "doc_id", "text", found)


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of every document: doc_id, seg_no, seg_lang, confidence, begin, end, n_segs."""
    docs = load(spark, d, "documents", DOCUMENTS)
    filters = language.learn(docs, "doc_id", "text", "lang")
    return language.find_languages(docs, "doc_id", "text", filters)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", DOCUMENTS)
    filters = language.learn(docs, "doc_id", "text", "lang")
    keyed = docs.select(F.struct("doc_id", language.label_code("lang").alias("code")).alias("doc"), "text")
    found = language.find_languages(keyed, "doc", "text", filters)
    wrong = (F.col("n_segs") > 1) | F.col("doc.code").isNull() | (F.col("doc.code") != F.col("seg_lang"))
    return found.filter(wrong).select("doc.doc_id", "seg_no", "seg_lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Each document's language: the one of most of its text, with the confidence over its stretches in that language, weighted by length."""
    segments = p9_segments(spark, d).withColumn("size", F.col("end") - F.col("begin"))
    per_lang = segments.groupBy("doc_id", "seg_lang").agg(F.sum("size").alias("size"), (F.sum(F.col("size") * F.col("confidence")) / F.sum("size")).alias("confidence"))
    top = per_lang.groupBy("doc_id").agg(F.max(F.struct("size", F.col("seg_lang").alias("lang"), "confidence")).alias("top"), F.sum("size").alias("all"))
    return top.select("doc_id", "top.lang", "top.confidence", (F.col("top.size") / F.col("all")).alias("share"))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_consensus": p4_consensus, "p4_annotators": p4_annotators, "p5_found": p5_found, "p5_links": p5_links, "p6_found": p6_found, "p6_frequency": p6_frequency, "p7_found": p7_found, "p7_pack": p7_pack, "p7_fill": p7_fill, "p8_found": p8_found, "p8_spans": p8_spans, "p8_clean": p8_clean, "p9_found": p9_found, "p9_segments": p9_segments, "p9_languages": p9_languages}
TIDY_NODE = "nullif(regexp_replace(replace(trim({0}), '\\', '/'), '^\\./', ''), '')"
STEPS_SQL = """runs AS (SELECT DISTINCT ON (pass_no) * FROM map_runs),
 fl AS (SELECT pass_no, repo, area, run_id, written_at, unnest(flows) AS flow FROM runs),
 st AS (SELECT pass_no, repo, area, run_id, written_at, flow.id AS flow_id, unnest(flow.steps) AS s FROM fl)"""
SETS_SQL = f"""WITH {STEPS_SQL},
 vals AS (SELECT s.step_no AS n, unnest(list_concat(coalesce(s.code_path, []), coalesce(s.ui, []))) AS v FROM st),
 toks AS (SELECT DISTINCT n, {TIDY_NODE.format("v")} AS v FROM vals WHERE {TIDY_NODE.format("v")} IS NOT NULL),
 sizes AS (SELECT n, count(*) AS k FROM toks GROUP BY n),
 both_ AS (SELECT a.n AS x, b.n AS y, count(*) AS o FROM toks a JOIN toks b ON a.v = b.v AND a.n < b.n GROUP BY ALL),
 pairs AS (SELECT x, y FROM both_ JOIN sizes p ON p.n = x JOIN sizes q ON q.n = y WHERE 5 * o >= 3 * (p.k + q.k - o))"""
FREQUENCY_SQL = f"""WITH {STEPS_SQL},
 recs AS (SELECT 's' || s.step_no AS r, unnest(s.code_path) AS v FROM st
  UNION ALL SELECT 'e' || edge_no, unnest([src, dst]) FROM (SELECT DISTINCT ON (edge_no) * FROM graph_edges)),
 total AS (SELECT (SELECT count(DISTINCT s.step_no) FROM st) + (SELECT count(DISTINCT edge_no) FROM graph_edges) AS n),
 counted AS (SELECT {TIDY_NODE.format("v")} AS node, count(*) AS occurrences, count(DISTINCT r) AS records FROM recs WHERE {TIDY_NODE.format("v")} IS NOT NULL GROUP BY 1),
 marked AS (SELECT node, occurrences, records, CASE WHEN records <= 1 THEN 'rare' WHEN records * 400 >= n THEN 'common' END AS mark FROM counted, total)"""
ORACLES = {
    "p2_found": """WITH RECURSIVE m AS (SELECT left_step AS a, right_step AS b FROM step_matches WHERE is_match AND left_step IS NOT NULL AND right_step IS NOT NULL),
 e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
 c(v, w) AS (SELECT a, a FROM e UNION SELECT c.v, e.b FROM c JOIN e ON c.w = e.a)
SELECT v AS step_no, min(w) AS group_no FROM c GROUP BY v""",
    "p5_found": SETS_SQL + " SELECT x AS step_a, y AS step_b FROM pairs",
    "p5_links": SETS_SQL
    + """, sets AS (SELECT n, list_sort(list(v)) AS v FROM toks GROUP BY n), cls AS (SELECT n, min(n) OVER (PARTITION BY v) AS class_no FROM sets),
 ends AS (SELECT x AS n FROM pairs UNION ALL SELECT y FROM pairs)
SELECT n AS step_no, class_no, (SELECT count(*) FROM ends WHERE ends.n = cls.n) AS links FROM cls""",
    "p6_found": FREQUENCY_SQL + " SELECT node, mark FROM marked WHERE mark IS NOT NULL",
    "p6_frequency": FREQUENCY_SQL + " SELECT * FROM marked",
}
