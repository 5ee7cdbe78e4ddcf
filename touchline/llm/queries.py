"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import boosted_quality, bpe_automaton, crf_language, decontaminate, oracles, piece_counts, prefix_trie, risk_rules, simhash, suffix_tree, token_planes, url_rules, warc, word_runs
from touchline.llm.common import BLANK_RUN, in_fold, settle, table, tokenizer_path
from touchline.session import checkpoint_dir

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through byte planes on disk and back; digests come from what was read."""
    path = scratch(spark, "planes")
    token_planes.write_planes(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_planes.read_documents(spark, path).select(
        "doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by four rules."""
    rules = spark.sql(
        "select * from values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), "
        "('org', '/fr/', 'allow') as r(host, path, verdict)"
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op2_url_rules"] = oracles.URL_RULES


@query
def op3_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; trees are grown on labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", boosted_quality.statistics("text").alias("statistics"))
    described = settle(docs.withColumn("held_out", in_fold("doc_id")), "statistics")
    trees = boosted_quality.fit(described.where("not held_out"), table(spark, sf_dir, "labels"))
    scored = described.select("doc_id", "held_out", boosted_quality.score("statistics", trees).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op4_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives and back, in the order of the merged capture histories.

    `pages` has no time of capture; page p counts as captured p seconds after the start of 2024.
    """
    path = scratch(spark, "warc")
    start = F.unix_seconds(F.lit("2024-01-01T00:00:00Z").cast("timestamp"))
    captures = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.timestamp_seconds(start + F.col("page_id")).alias("captured_at"), F.col("html").alias("payload")
    )
    warc.write_archives(captures, path)
    return warc.merge_runs(warc.read_captures(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position"
    )


ORACLES["op4_warc_histories"] = oracles.WARC


@query
def op5_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counts = piece_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item it holds."""
    items = table(spark, sf_dir, "benchmark").select("item_id", *decontaminate.split_item("text"))
    found = decontaminate.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), items)
    return found.select("doc_id", F.explode("hits").alias("_h")).select(
        "doc_id", "_h.item_id", "_h.score", "_h.question_overlap", "_h.answer_overlap", "_h.passage"
    )


@query
def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a field learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = crf_language.predict("text", crf_language.fit(docs), spark)
    return docs.select("doc_id", in_fold("doc_id").alias("held_out"), found.alias("_l")).select("doc_id", "held_out", "_l.lang_pred", "_l.score")


@query
def op8_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether it is kept; strata are languages."""
    judged = risk_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op8_risk_rules"] = oracles.RISK_RULES


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the automaton, then decoded from its ids; digests of both."""
    path = tokenizer_path("byte_bpe_50k.json")
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe_automaton.encode("text", path).alias("ids"))
    return ids.withColumn("decoded", bpe_automaton.decode("ids", path)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query
def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under word counts and under a suffix tree, both learned outside one fold."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return suffix_tree.score_all(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


@query
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document; in a tenth of them the words from one place on are first made periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANK_RUN), lambda w: w != "")
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    from_word = g % n
    period = 1 + F.floor((n - from_word) / (3 + g % 8))
    repeated = F.transform(F.col("_words"), lambda w, i: F.when(i < from_word, w).otherwise(F.get("_words", (from_word + (i - from_word) % period).cast("int"))))
    chosen = F.coalesce(F.col("_h") % 10 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("_h"))
    plain = docs.where(~chosen).select("doc_id", "text")
    # only the chosen are cut into words here
    made = docs.where(chosen).select("doc_id", "_h", words.alias("_words")).select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise("").alias("text"))
    found = plain.union(made).select("doc_id", word_runs.word_runs("text").alias("_f")).select("doc_id", "_f.*")
    top = word_runs.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", top.alias("_top")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_top.start", "_top.length", "_top.period",
        F.floor(1000 * F.col("_top.length") / F.col("_top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each rebuilt from the first turns of another one and its own later turns."""
    turns = settle(prefix_trie.turn_ids(table(spark, sf_dir, "conversations")), "turns")
    borrowed = F.crc32(F.col("conv_id").cast("string")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    convs = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), borrowed.alias("borrowed"))
    heads = turns.where("pos <= 8").select(F.col("conv_id").alias("base"), F.col("pos").alias("at"), "turn_id", "n_bytes")
    first = convs.join(heads, "base").where(F.col("at") <= F.col("borrowed")).select("conv_id", "at", "turn_id", "n_bytes")
    rest = turns.where(F.col("pos") > borrowed).select("conv_id", (F.col("pos") + 8).alias("at"), "turn_id", "n_bytes")
    empty = convs.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).cast("long").alias("n_bytes"))
    rebuilt = first.union(rest).union(empty).select("conv_id", F.col("at").alias("pos"), "turn_id", "n_bytes", base.alias("family"))
    return prefix_trie.prefix_trie(rebuilt, near="family")
