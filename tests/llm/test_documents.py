"""op3, op6, op7, op8 and op9 against brute force, held-out accuracy and odd cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS, docs_of
from touchline.llm import boosted_quality, crf_language, decontaminate, queries, risk_rules, simhash
from touchline.llm.components import connected_components

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# SimHash


def slow_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fingerprints):
    """Least index reachable over fingerprints within two bits."""
    n, root = len(fingerprints), list(range(len(fingerprints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(n):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_fingerprints(frame):
    docs = frame(docs_of(ODD_TEXTS)).withColumn("fingerprint", F.lit("clash"))
    for r in simhash.components(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["fingerprint"] == f"{slow_fingerprint(r['text']):016x}"


@pytest.mark.parametrize("longest", [1, 3, 32])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, longest):
    monkeypatch.setattr(simhash, "LONGEST_LIST", longest)
    rng, prints = random.Random(longest), []
    for _ in range(12):  # clusters, chains and strangers
        seed = rng.getrandbits(64)
        for _ in range(12):
            prints.append(seed)
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    found = connected_components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()
    roots = {r["node"]: r["root"] for r in found}
    want = slow_components([p & (1 << 64) - 1 for p in prints])
    assert [roots.get(p, p) for p in prints] == [prints[k] for k in want]


def test_components_of_rows(frame):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(400)) for _ in range(6)]
    texts = base + [t + " end" for t in base] + base + [None, "", " ", "a b", "A  b"]
    rows = [(i + 5, t) for i, t in enumerate(texts)] + [(None, base[0]), (7, base[2]), (None, "alone")]
    rng.shuffle(rows)
    docs = frame([(i, t, None, None, 0) for i, t in rows])
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.components(docs).collect()}
    prints = [slow_fingerprint(t) for _, t in rows]
    groups = defaultdict(list)
    for (i, _), root in zip(rows, slow_components(prints)):
        groups[root].append(i)
    for (i, _), p, root in zip(rows, prints, slow_components(prints)):
        ids = [x for x in groups[root] if x is not None]
        assert got[i, f"{p:016x}"] == (min(ids) if ids else None)
    assert simhash.components(docs).count() == len(rows)
    assert simhash.components(docs.limit(0)).count() == 0


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert found == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}


# BM25 and block-max WAND


def test_search_returns_all_above_the_threshold(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 8)
    rng = random.Random(5)
    words = [f"w{k}".encode() for k in range(60)]
    for _ in range(20):
        items = [(k, [rng.choice(words) for _ in range(rng.randint(1, 12))], []) for k in range(200)]
        frequency = Counter(w for i in items for w in set(i[1]))
        index = decontaminate.Index(items, frequency, 200, 6.0)
        for _ in range(10):
            query = sorted(index.term[w] for w in rng.sample(words, rng.randint(1, 25)) if w in index.term)
            least, scores = rng.choice([0.2, 0.4, 0.5, 0.7, 0.95]), Counter()
            for t in query:
                for item, impact in index.postings[t]:
                    scores[item] += impact
            got = [i for b in range(index.tops.shape[1]) for i, _ in index.search(query, b, least)]
            assert sorted(got) == sorted(i for i, s in scores.items() if s >= least - 1e-9)


@pytest.mark.parametrize("shard_bytes", [1, 8 << 20])
def test_items_are_found_and_clean_texts_are_not(frame, spark, shard_bytes):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(k, say(30), say(8)) for k in range(4)] + [(9, None, None), (10, "", "")]
    hold = lambda q, a: f"{say(150)} {q.upper()},\n{a}! {say(150)}"
    texts = [hold(items[0][1], items[0][2]), items[1][1] + " " + items[1][2], hold(items[2][1], say(8)), say(500), hold(say(30), items[3][2])]
    docs = frame(docs_of(texts + ODD_TEXTS)).withColumn("item_id", F.lit("clash"))
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    found = decontaminate.hits(docs, table, shard_bytes=shard_bytes)
    assert {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in found.collect() if r["hits"]} == {0: [0], 1: [1]}
    assert found.columns == [*docs.columns, "hits"] and found.count() == docs.count()
    assert decontaminate.hits(docs, table.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.hits(docs.limit(0), table).count() == 0


def test_scattered_words_do_not_hide_the_item_behind_them(frame, spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    question, answer = say(14), say(6)
    words = f"{question} {answer}".split()
    scattered = " ".join(rng.sample(words, len(words)))
    altered = " ".join(words[:10] + ["other"] + words[11:])  # fewer of the item's words than the scattered ones
    texts = [f"{scattered} {say(900)} {question} {answer} {say(50)}", f"{scattered} {say(900)} {altered}", f"{say(20)} {scattered} {say(900)}"]
    table = spark.createDataFrame([(1, question, answer), (2, say(60), say(20))], "item_id long, question string, answer string")
    found = {r["doc_id"]: r["hits"] for r in decontaminate.hits(frame(docs_of(texts)), table).collect()}
    assert {d: [h["item_id"] for h in hits] for d, hits in found.items()} == {0: [1], 1: [1], 2: []}
    assert all(found[d][0]["passage"] > 700 for d in (0, 1))


@pytest.mark.parametrize("n_question,n_answer", [(1, 30), (3, 30), (4, 30), (9, 30), (30, 2), (30, 6)])
def test_one_changed_word_in_a_short_part_is_still_found(frame, spark, n_question, n_answer):
    rng = random.Random(n_question)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    question, answer = say(n_question), say(n_answer)
    short = min(question, answer, key=len)
    copies = []
    for k in range(len(short)):
        changed = short[:k] + ["other"] + short[k + 1 :]
        copies.append(" ".join(say(100) + (changed + answer if short is question else question + changed) + say(100)))
    clean = [" ".join(say(100) + short + say(100)), " ".join(say(300))]
    table = spark.createDataFrame([(1, " ".join(question), " ".join(answer))], "item_id long, question string, answer string")
    found = decontaminate.hits(frame(docs_of(copies + clean)), table).where("size(hits) > 0").collect()
    assert {r["doc_id"] for r in found} == set(range(len(copies)))


def test_planted_items_of_the_given_tables(spark):
    spell = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
    items = {r["item_id"]: spell(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: spell(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op6_decontaminate(spark, SF).collect()} == want and want


# Random field


def brute_marginals(emit, move):
    steps, states = emit.shape
    totals = np.zeros_like(emit)
    for path in np.ndindex(*([states] * steps)):
        weight = math.exp(sum(emit[t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        for t, s in enumerate(path):
            totals[t, s] += weight
    return totals / totals.sum(axis=1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(1)
    emit, move, lengths = rng.normal(size=(5, 4, 3)), rng.normal(size=(3, 3)), np.array([5, 1, 3, 4])
    found, moves = crf_language.forward_backward(emit, lengths, move)
    for k, n in enumerate(lengths):
        assert np.allclose(found[:n, k], brute_marginals(emit[:n, k], move)) and not found[n:, k].any()
    assert np.isclose(moves.sum(), (lengths - 1).sum())


def test_languages_of_held_out_documents(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op7_crf_language(spark, SF).join(lang, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_code_switched_words_are_labelled():
    field = crf_language.train([("the house and the tree of them " * 9, "en"), ("der baum und das haus von ihnen " * 9, "de")])
    reader = crf_language.Reader(field)
    chain = reader.chain("the tree of them der baum und das 12 , haus")
    found, _ = crf_language.forward_backward(reader.emit[chain][:, None, :], np.array([len(chain)]), field.move)
    assert [field.languages[k] for k in found[:, 0].argmax(axis=1)] == ["en"] * 4 + ["de"] * 5


def test_language_of_odd_texts(spark, frame):
    docs = frame(docs_of(ODD_TEXTS) + [(1000 + k, "the house of them and", "en", "s", 9) for k in range(10)] + [(None, "un deux trois", None, "s", 1)])
    docs = docs.withColumn("lang_pred", F.lit("clash"))
    field = crf_language.fit(docs)
    rows = docs.select("doc_id", "text", crf_language.predict("text", field, spark).alias("l")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        bare = not any(c.isalpha() for c in r["text"] or "")
        assert (r["l"]["lang_pred"] == "und") == bare and (not bare or r["l"]["score"] == 0)
    assert crf_language.fit(docs.where("lang is null")) is None
    assert docs.select(crf_language.predict("text", None, spark)["lang_pred"].alias("p")).distinct().collect()[0]["p"] == "und"


# Boosted trees


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op3_boosted_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_flat_traversal_equals_walking():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, boosted_quality.N_FEATURES))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    trees = boosted_quality.grow(x, y)
    scores = trees.scores(x)
    assert ((scores > 0.5) == y).mean() > 0.95
    for row, score in zip(x[:40], scores):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert np.isclose(score, 1 / (1 + math.exp(-total)))


def test_quality_of_odd_texts(spark, frame):
    docs = frame(docs_of(ODD_TEXTS)).withColumn("statistics", F.lit("clash")).withColumn("quality", F.lit(5))
    described = docs.select("doc_id", boosted_quality.statistics("text").alias("statistics"))
    some = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for labels in (some, some.limit(0), some.where("quality = 1")):
        trees = boosted_quality.fit(described, labels)
        scores = [r[0] for r in described.select(boosted_quality.score("statistics", trees)).collect()]
        assert len(scores) == len(ODD_TEXTS) and all(0 <= s <= 1 for s in scores)


# Certified cutoffs


def slow_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    marked = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in risk_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(marked),
    )


def test_measures(frame):
    rng = random.Random(8)
    texts = ODD_TEXTS + ["".join(rng.choice(["a ", "b ", "c\n", "# ", "d e f g h ", "\t", "\x85"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = frame(docs_of(texts)).withColumn("n_words", F.lit("clash"))
    for r in risk_rules.measures(docs.select("doc_id", "text"), ["doc_id"]).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == slow_measures(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_binomial_tail(spark):
    rows = spark.createDataFrame([(n, k) for n in (1, 10, 500) for k in range(0, n + 1, max(1, n // 20))], "n long, k long")
    for r in rows.select("n", "k", risk_rules.binomial_below(F.col("n"), F.col("k"), 0.05).alias("p")).collect():
        exact = sum(math.comb(r["n"], i) * 0.05**i * 0.95 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == (1.0 if r["k"] >= 0.05 * r["n"] else pytest.approx(exact, rel=1e-9))


def test_cutoffs_lose_few_good_documents(spark):
    judged = risk_rules.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    rows = judged.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 1 - risk_rules.RISK and np.mean(bad) < 0.5


def test_rules_with_odd_rows(spark, frame):
    docs = frame(docs_of(ODD_TEXTS) + [(None, "w " * 20, None, None, None), (3, "v " * 20, "en", "s", 1)])
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    for own in (labels, labels.limit(0)):
        rows = risk_rules.judge(docs, own).collect()
        assert len(rows) == docs.count()
        assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert risk_rules.judge(docs.limit(0), labels).count() == 0


def test_every_language_is_learned(frame):
    """More languages than any cap would allow, one of which has long texts only, and rows without ids."""
    rng = random.Random(9)
    stems = {f"l{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.randrange(1000)}{c}".translate(str.maketrans("0123456789", "qwertyuiop")) for c in "xyzuvw"] for k in range(70)}
    rows = [(100 * k + j, " ".join(rng.choice(words) for _ in range(30)), lang, "s", 0) for k, (lang, words) in enumerate(stems.items()) for j in range(3) if lang != "l07"]
    rows += [(None, " ".join(rng.choice(stems["l07"]) for _ in range(6000)), "l07", "s", 0)] * 3
    field = crf_language.fit(frame(rows), held_out=False)
    assert field.languages == sorted(stems)
    asked = frame([(k, " ".join(words * 3), None, "s", 0) for k, words in enumerate(stems.values())])
    got = asked.select("doc_id", crf_language.predict("text", field, asked.sparkSession).alias("l")).select("doc_id", "l.lang_pred").collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id']:02d}" for r in got) >= 66
