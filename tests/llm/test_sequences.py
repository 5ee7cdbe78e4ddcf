"""op11, op12 and op13 against brute force and odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS, docs_of
from touchline.llm import prefix_trie, queries, suffix_tree, word_runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


# Suffix tree


def slow_model(texts, depth, discount, share):
    """Counts of every run of words, and the log probability of a word after a context, straight from the definitions."""
    seqs = [["<start>", *WORD.findall(lowered(t)), ""] for t in texts]
    c = Counter(w for s in seqs for w in s[1:])
    total, weight = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    least = max(2, share * total)
    grams = Counter(tuple(s[i : i + k]) for s in seqs for k in range(2, depth + 2) for i in range(len(s) - k + 1))
    places = Counter(tuple(s[i : i + k]) for s in seqs for k in range(1, depth + 1) for i in range(len(s) - k))
    heads = {w for w in c if c[w] >= least} | {"<start>", ""}
    next_words = {}
    for g, n in grams.items():
        if n >= least and all(w in heads for w in g):
            next_words.setdefault(g[:-1], {})[g[-1]] = n
    states = {}

    def prob(context, word, cut=discount):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (c.get(word, 0) + 0.5) / weight
        found, n = next_words[context], places[context]
        left = 1 - sum(x - cut for x in found.values()) / n
        return max(found.get(word, 0) - cut, 0) / n + left * prob(context[1:], word)

    for k in range(1, depth + 1):
        for context in sorted((g for g in next_words if len(g) == k), key=str):
            found, n = next_words[context], places[context]
            left = max(1 - sum(x - 1 for x in found.values()) / n, 1e-12)
            gain = (n - sum(found.values())) * math.log(left)
            for w, x in found.items():
                p = prob(context[1:], w)
                gain += x * math.log(((x - 1) / n + left * p) / p)
            if gain >= math.log(max(total, 2)):
                states[context] = True
    return c, total, weight, states, prob


@pytest.mark.parametrize("share", [5e-6, 0.002])
def test_scores_follow_the_definition(frame, monkeypatch, share):
    rng = random.Random(3)
    words = ["a", "b", "c", "D", "e"]
    train = [" ".join(rng.choice(words[: 1 + k % 5]) for _ in range(rng.randrange(40))) for k in range(40)] + ["x y z w v u"] * 6
    asked = [*train[:10], "x y z", "q x y z w new", "", None, "a b\tc\n d x Y  z", "z" * 100]
    monkeypatch.setattr(suffix_tree, "LEAST_SHARE", share)
    model = suffix_tree.fit(frame(docs_of(train)).select("text"))
    c, total, weight, states, prob = slow_model(train, suffix_tree.DEPTH, suffix_tree.DISCOUNT, share)
    assert sum(int(level.is_state.sum()) for level in model.tree.levels) == len(states) > 3
    docs = frame(docs_of(asked)).withColumn("score", F.lit("clash"))
    for r in suffix_tree.score_texts(docs, model).collect():
        s = ["<start>", *WORD.findall(lowered(asked[r["doc_id"]])), ""]
        want = sum(math.log10(prob(tuple(s[max(0, i - suffix_tree.DEPTH) : i]), s[i])) for i in range(1, len(s)))
        base = sum(math.log10((c.get(w, 0) + 0.5) / weight) for w in s[1:])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s) - 1, sum(w in c for w in s[1:]), total)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(want, abs=1e-6)


def test_what_is_seen_twice_in_a_large_corpus_counts(frame, monkeypatch):
    """Contexts and next words are not left out for being rare; many batches, parts and turns."""
    monkeypatch.setattr(suffix_tree, "PART_TOKENS", 50_000)
    train = ["a b c a " * 50_000] * 3 + ["p q r s t u v a b"] * 2 + ["c q r x"]
    asked = ["p q r s t u v a b", "q r s t", "a b c", "c q r x"]
    docs, texts = frame(docs_of(asked)), frame(docs_of(train)).select("text")
    c, total, weight, states, prob = slow_model(train, suffix_tree.DEPTH, suffix_tree.DISCOUNT, 0)
    assert (b"p",) in states and total > 400_000
    for r in suffix_tree.score_texts(docs, suffix_tree.fit(texts)).collect():
        s = ["<start>", *asked[r["doc_id"]].encode().split(), ""]
        want = sum(math.log10(prob(tuple(s[max(0, i - suffix_tree.DEPTH) : i]), s[i])) for i in range(1, len(s)))
        assert r["score"] == pytest.approx(want, abs=1e-6)


def test_next_words_are_a_distribution(frame):
    train = ["a b c a b d", "a b c", "b c a b c e f", "a b c a"] * 5
    model = suffix_tree.fit(frame(docs_of(train)).select("text"))
    c, total, weight, states, prob = slow_model(train, suffix_tree.DEPTH, suffix_tree.DISCOUNT, suffix_tree.LEAST_SHARE)
    for context in states:
        assert sum(prob(context, w) for w in c) + prob(context, "never seen") == pytest.approx(1, abs=1e-9)
    assert model.tree.levels[0].is_state.any()


def test_suffix_tree_takes_odd_texts_and_nothing(frame):
    model = suffix_tree.fit(frame(docs_of(ODD_TEXTS)).select("text"))
    rows = suffix_tree.score_texts(frame(docs_of(ODD_TEXTS)), model).collect()
    assert len(rows) == len(ODD_TEXTS) and all(r["score"] <= 0 and r["n_known"] == r["n_tokens"] for r in rows)
    assert suffix_tree.score_texts(frame([]), model).count() == 0
    empty = suffix_tree.fit(frame([]).select("text"))
    for r in suffix_tree.score_texts(frame(docs_of(["a b", None])), empty).collect():
        assert (r["score"], r["base_score"], r["n_known"], r["train_tokens"]) == (0, 0, 0, 0)


def test_contexts_help_unseen_texts(spark):
    rows = [r for r in queries.op11_suffix_tree(spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# Runs


def slow_lyndon(codes):
    out = [0] * len(codes)
    for i, c in enumerate(codes):
        j, k = i + 1, i
        if c < 0:
            continue
        while j < len(codes) and codes[j] >= 0 and codes[j] >= codes[k]:
            k = i if codes[j] > codes[k] else k + 1
            j += 1
        out[i] = j - k
    return out


def slow_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            least = not any(all(w[x] == w[x + d] for x in range(start, start + length - d)) for d in range(1, q))
            if length >= max(6, 4 * q) and least:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays():
    rng = random.Random(1)
    for k in range(1500):
        codes = [rng.randrange(-1 if k % 3 == 0 else 0, rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(40))]
        assert word_runs.lyndon_array(codes) == slow_lyndon(codes)


def _periodic(rng):
    w = [str(rng.randrange(rng.choice([1, 2, 3, 5]))) for _ in range(rng.randrange(80))]
    if w and rng.random() < 0.5:
        s, p = rng.randrange(len(w)), 1 + rng.randrange(6)
        w[s:] = [w[min(s + (i - s) % p, len(w) - 1)] for i in range(s, len(w))]
    return w


@pytest.mark.parametrize("part", [50, 400_000])
def test_runs_are_all_and_maximal(monkeypatch, part):
    monkeypatch.setattr(word_runs, "PART_WORDS", part)
    rng = random.Random(2)
    texts = [_periodic(rng) for _ in range(1500)]
    for w, (n, runs, collapsed) in zip(texts, word_runs.runs_of([" ".join(w).encode() for w in texts])):
        want = slow_runs(w)
        assert (n, [(r["start"], r["length"], r["period"]) for r in runs]) == (len(w), want)
        dropped = {k for s, length, q in want for k in range(s + q, s + length)}
        assert collapsed == " ".join(x for k, x in enumerate(w) if k not in dropped)


def test_runs_of_odd_texts(frame):
    docs = frame(docs_of(ODD_TEXTS)).withColumn("runs", F.lit("clash"))
    for r in docs.select("doc_id", "text", word_runs.word_runs("text").alias("f")).collect():
        words = WORD.findall((r["text"] or "").encode())
        assert r["f"]["n_words"] == len(words)
        if len(words) < 5000:
            assert [(x["start"], x["length"], x["period"]) for x in r["f"]["runs"]] == slow_runs(words)
        else:
            assert [(x["start"], x["length"], x["period"]) for x in r["f"]["runs"]] == [(0, len(words), 1)]
    assert frame([]).select(word_runs.word_runs("text")).count() == 0


def test_runs_query(spark):
    got = {r["doc_id"]: tuple(r) for r in queries.op12_word_runs(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = WORD.findall((r["text"] or "").encode())
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if n > 2000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(w)
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = b" ".join(x for k, x in enumerate(w) if k not in dropped)
        milli = 1000 * top[1] // top[2] if runs else None
        assert got[r["doc_id"]] == (r["doc_id"], len(runs), *top, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


# Trie


def slow_trie(convs):
    """Nodes of the trie over {conv_id: [(role, text)]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = (dict.fromkeys(members, 0) for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
            leaves[k[:d]] += children[k] == 0
    out = []
    for k, m in members.items():
        ended = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(k)))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}


def test_trie_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = sorted(map(tuple, queries.op13_prefix_trie(spark, SF).collect()), key=str)
    assert got == slow_trie(rebuilt(map(tuple, rows)))


def test_trie_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    monkeypatch.setattr(prefix_trie, "TREE_KEYS", 7)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["u", None, ""]), rng.choice(["x", "é", "", None])) for c in range(40) for t in range(rng.randrange(12))]
    rows += [(None, 1, "u", "x"), (41, None, None, None), (42, 7, "u", "long " * 50_000)] + [(43, k, "u", "same") for k in range(25)] + [(44, k, "u", "same") for k in range(25)]
    ddl = "conv_id long, turn long, role string, text string, pos string, key string"
    spark.createDataFrame([(*r, "p", "k") for r in rows], ddl).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, queries.op13_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == slow_trie(rebuilt(rows))
    spark.createDataFrame([], ddl).write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert queries.op13_prefix_trie(spark, str(tmp_path / "none")).collect() == []


def test_node_layouts_grow():
    tree, rng = prefix_trie.RadixTree(), random.Random(6)
    keys = sorted({bytes(rng.randrange(256) for _ in range(2)) + bytes(rng.randrange(3) for _ in range(14)) for _ in range(4000)})
    for k, key in rng.sample(list(enumerate(keys)), len(keys)):
        tree.insert(key, k)
    order, nodes = tree.walk()
    assert order == list(range(len(keys)))  # keys in the order of their bytes
    assert tree.root.capacity == 256 and {n.capacity for _, n in tree.root.items()} == {16, 48}
    assert all(path == key[: len(path)] for _, path, first, last in nodes for key in (keys[order[k]] for k in range(first, last)))
    assert np.all([len(n.prefix) < 16 for _, n in tree.root.items()])
