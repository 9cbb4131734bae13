"""Spelling groups, rules with the forest, and the Merkle manifest against plain versions and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tapewright.llm import merkle, rules, spelling

# ---------------------------------------------------------------- spelling


def variants_by_definition(rows, every):
    total = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, own in beside.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(beside[w]), words[form[w]] if w in form else None))
    return out


def edited(rng, word, letters):
    k, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:k] + ("" if kind == 0 else rng.choice(letters)) + word[k + (kind != 1) :]


@pytest.mark.parametrize("letters", ["ab", "abcdefÀé", "ß÷×ÿ"])
def test_spelling_follows_the_definition(spark, letters):
    rng, words = random.Random(len(letters)), ["aaaaa", "aaaaaa"]
    for _ in range(30):
        words.append("".join(rng.choice(letters) for _ in range(rng.randint(5, 9))))
    for _ in range(60):
        words.append(edited(rng, rng.choice(words), letters))
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=300))) for i in range(12)]
    rows += [(None, words[0] + "1" + words[1].upper()), (20, None), (21, ""), (22, "\n \x00 123"), (23, words[2] * 3000), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert {tuple(r) for r in spelling.variants(docs, 7).collect()} == variants_by_definition(rows, 7)
    assert {tuple(r) for r in spelling.variants(docs).collect()} == variants_by_definition(rows, None)


def test_spelling_chains_empty_tables_and_short_words(spark):
    chain = ["abcde", "abcdf", "abcgf", "abhgf", "aihgf", "jihgf"]
    words = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    found = {r["word"]: r for r in spelling.group(words).collect()}
    assert all(found[w]["root"] == chain[-1] for w in chain) and found[chain[0]]["form"] == chain[1] and found[chain[-1]]["form"] is None
    assert spelling.group(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group(spark.createDataFrame([("abcd", 9)], "word string, n long"))


def test_no_side_of_a_word_join_is_broadcast(spark):
    words = spark.createDataFrame([("abcde", 9), ("abcdf", 3), ("vwxyz", 4)], "word string, n long")
    for out, joins in ((spelling.near_words(words), 1), (spelling.group(words), 3)):
        plan = out._jdf.queryExecution().executedPlan().toString()  # before it runs: sides are sized by guess
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == joins
    assert {(r["word"], r["form"]) for r in spelling.group(words).collect()} == {("abcde", None), ("abcdf", "abcde"), ("vwxyz", None)}


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(1)
    for _ in range(300):
        prefix = sorted((p, rng.randint(1, 9)) for p in rng.sample(range(12), rng.randint(3, 7)))
        a, b = spelling.pivots(prefix)
        cost = dict(prefix)
        assert b - a >= 2 and cost[a] + cost[b] == min(f + g for p, f in prefix for q, g in prefix if q - p >= 2)


# ---------------------------------------------------------------- rules


def counts_by_definition(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside)]


ODD = [None, "", " \n\t\n", "x", "a b c d e " * 40, "é ☃ 𝒳 #* |\r\nx\r\nx\r\n x\n", "\x1c \x85     a", "one two\nthree four five six seven eight nine ten eleven", "word " * 20_000, "<|>" * 5000]


def test_counts_follow_the_definition():
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["a", "b", "c#", "d\n", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text in texts:
        assert rules.statistics(None if text is None else text.encode())[0] == counts_by_definition(text)


def test_forest_paths_are_those_of_a_plain_walk():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 4)), 1)
    forest = rules.fit(x, trees=7, sample=64)
    depth = int(np.log2(forest.feature.shape[1] + 1))

    def path(t, row):
        node = 0
        for _ in range(depth):
            node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.cut[t, node])
        return forest.path[t, node - forest.feature.shape[1]]

    plain = [2 ** -(np.mean([path(t, row) for t in range(7)]) / float(rules.mean_path(64))) for row in x]
    assert np.allclose(forest.scores(x), plain)
    # a leaf of the sample's rows has a path of its depth and more, and every row of the sample has one
    assert forest.path.min() >= 0 and forest.scores(np.full((1, 4), 9.0))[0] > np.median(forest.scores(x))
    assert rules.fit(np.zeros((0, 4))).scores(np.zeros((2, 4))).shape == (2,)
    assert rules.fit(np.zeros((5, 4))).scores(np.zeros((1, 4)))[0] <= 1


def test_threshold_is_the_best_allowed_cut():
    scores, good = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), np.array([True, True, False, True, False, False])
    assert 0.4 < rules.threshold(scores, good, 0.0) < 0.5
    assert rules.threshold(scores, good, 0.5) == pytest.approx(0.25) or 0.4 < rules.threshold(scores, good, 0.5) < 0.5
    assert rules.threshold(scores, np.ones(6, bool), 0.1) == np.inf


def test_rules_judge_every_row(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = rules.train(docs, labels)
    found = {r.doc_id: r for r in rules.judge(docs, forest).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert found.keys() == texts.keys()
    for i, r in found.items():
        wanted = counts_by_definition(texts[i])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == wanted
        assert r.base_failed == (wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0]) and not (r.base_failed and r.kept)
    assert {r.doc_id for r in rules.keep(docs, forest).collect()} == {i for i, r in found.items() if r.kept}
    odd = spark.createDataFrame([(i if i % 3 else None, t, "c", 1.0) for i, t in enumerate(ODD * 2)], "doc_id long, text string, kept string, anomaly double")
    assert rules.judge(odd, forest).count() == 2 * len(ODD) and rules.judge(odd.limit(0), forest).count() == 0
    assert rules.keep(odd, forest).columns == odd.columns
    lax = rules.train(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in rules.judge(docs, lax).collect())


def test_held_out_rows_good_ones_stay_and_odd_ones_go(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    forest = rules.train(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 0"))
    held = rules.judge(docs, forest).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 2 = 1 and not base_failed").collect()
    kept = {q: np.mean([r.kept for r in held if r.quality == q]) for q in (0, 1)}
    assert kept[1] > 0.975 and kept[0] < 0.75


# ---------------------------------------------------------------- manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_by_definition(rows, every):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H("".join(map(field, (*r[:4], t))))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
        return out

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: tree([leaf(r, r[4]) for r in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for j, r in enumerate(by[s]):
            hit = every and r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0
            now, proof = leaf(r, r[4].replace("\n", "") if hit else r[4]), ""
            for levels, at in ((trees[s], j), (top, k)):
                for nodes in levels[:-1]:
                    own = at - at % 3
                    before, after = nodes[own:at], nodes[at + 1 : own + 3]
                    now, proof, at = H("".join([*before, now, *after])), proof + "".join([*before, *after]), at // 3
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], top[-1][0], H(proof), now, now == top[-1][0]))
    return out


def manifest_rows():
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "a", "a", "a", "b", "ñ"]), rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "x\ny", "long " * 10 + "\n"])) for i in range(150)]
    return rows + [(7, "a", "en", 5, "x"), (7, "a", "en", 5, "x"), (None, "a", "en", 5, "x\n"), (2**60 + 1, "a", "en", 1, "q"), (1, "solo", "x", 1, "t\n" * 40_000)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string"


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_follows_the_definition(spark, levels):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "t", "l") for r in rows], SCHEMA)
    assert sorted(map(str, map(tuple, merkle.manifest(docs, 2, levels).collect()))) == sorted(map(str, manifest_by_definition(rows, 2)))


def test_manifest_of_untampered_single_and_no_rows(spark):
    docs = spark.createDataFrame([(*r, "t", "l") for r in manifest_rows()], SCHEMA)
    assert merkle.manifest(docs).where("not verified").count() == 0
    (one,) = merkle.manifest(docs.where("source = 'solo'")).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H("")
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_thinned_edges_of_a_group_are_about_one_a_node(spark, tmp_path):
    from tapewright.llm import jaccard_join

    hubs, nodes = list(range(0, 80, 10)), [n for n in range(1, 400) if n % 10]
    pairs = [(min(h, n), max(h, n)) for n in nodes for h in hubs] + [(1000, 1001), (1002, 1001)]
    edges = spark.createDataFrame(pairs, "hub long, node long")
    thin = {(r["hub"], r["node"]) for r in jaccard_join._thinned(edges, f"file://{tmp_path}/thin").collect()}
    assert len(thin) <= 1.5 * (len(nodes) + len(hubs))
    labels = {r["node"]: r["comp"] for r in jaccard_join.components(edges, f"file://{tmp_path}/components").collect()}
    assert labels == {n: 0 for n in [*hubs, *nodes]} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_all_learning_documents_calibrate_the_language_model(spark):
    import numpy as np

    from tapewright.llm import langid

    # 2,400 easy texts of two languages and odd ones, which a sample of 2,000 would see in part only
    rows = [("x" if i % 2 else "y", f"{'abba baab' if i % 2 else 'cddc dccd'} {'ab' if i % 2 else 'cd'}{i % 7}") for i in range(2400)] + [("x", "cddc abba dccd")] * 37
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    model = langid.train(docs)
    entropy, _ = model.loaded().entropies([t for _, t in rows])
    right = np.array([model.languages.index(x) for x, _ in rows])
    own, z = entropy[np.arange(len(rows)), right], -(entropy - entropy.min(axis=1, keepdims=True))
    loss = [float(np.mean(np.log(np.exp(z * s).sum(axis=1)) - z[np.arange(len(rows)), right] * s)) for s in langid.SCALES]
    assert loss[int(np.abs(langid.SCALES - model.scale).argmin())] <= min(loss) + 1e-4
    for k in range(2):
        least = np.sort(own[right == k])[int(np.ceil(0.999 * (right == k).sum())) - 1]
        assert least < model.bound[k] - 0.25 <= least + 1 / langid.BINS + 1e-9


def test_thresholds_of_counted_scores_are_those_of_all_rows():
    import numpy as np

    from tapewright.llm import rules

    scores, good, times = np.array([0.2, 0.3, 0.4, 0.6]), np.array([True, True, True, False]), np.array([5, 3, 90, 4])
    assert rules.threshold(scores, good, 0.01, times) == rules.threshold(np.repeat(scores, times), np.repeat(good, times), 0.01) == 0.5


def test_no_text_meets_the_labels(spark, sf_dir, monkeypatch):
    from tapewright.llm import queries

    joins = []

    def walk(node):
        if node.nodeName() == "Join":
            joins.append(node.output().mkString(","))
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    own = rules.stored
    monkeypatch.setattr(rules, "stored", lambda df, *a: walk(df._jdf.queryExecution().optimizedPlan()) or own(df, *a))
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    wanted = rules.judge(docs, rules.train(docs, labels)).orderBy("doc_id").collect()
    assert queries.op12_rules(spark, sf_dir).orderBy("doc_id").collect() == wanted
    assert len(joins) == 2 and not any("text#" in j for j in joins)
