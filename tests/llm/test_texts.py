"""Language, licences, preference formatting, near copies and repeated passages on small cases."""

import random

import numpy as np
import pytest

from reviewlake.llm import language, licenses, order_minhash, passages, preference

rng = np.random.default_rng(17)


def words(n, seed):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(n)]


def changed(text, places):
    out = list(text)
    for p in places:
        out[p] = f"new{p}"
    return out


# ---- language -------------------------------------------------------------------------------
def labelled(spark):
    alphabets = {"aa": "abcde ", "bb": "vwxyz ", "cc": "mnopq "}
    rows = []
    for i in range(240):
        name = list(alphabets)[i % 3]
        rows.append((i, "".join(np.random.default_rng(i).choice(list(alphabets[name]), 400)), name if i % 7 else None, "held"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_language(spark):
    docs = labelled(spark)
    odd = spark.createDataFrame([(1000, None, None, None), (1001, "", None, None), (1002, "12 !?", "aa", None), (None, "abcde", None, None), (1003, "vwxyz " * 50_000, None, None), (1003, "vwxyz", None, None)], docs.schema)
    found = {(r.doc_id, i): r for i, r in enumerate(language.identify(docs.unionByName(odd)).collect())}
    assert len(found) == 246
    by_id = {}
    for (i, _), r in found.items():
        by_id.setdefault(i, []).append(r)
    names = ["aa", "bb", "cc"]
    right = [by_id[i][0].lang_pred == names[i % 3] for i in range(240)]
    assert np.mean(right) > 0.95
    assert [by_id[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000][0].score == 0
    assert len(by_id[1003]) == 2 and all(r.lang_pred == "bb" for r in by_id[1003])
    import zlib
    assert all(by_id[i][0].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert language.identify(docs.where("false")).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    kept = language.keep_identified(docs.unionByName(odd))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(240))
    assert not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}


# ---- licences -------------------------------------------------------------------------------
def brute(text, name_texts, least):
    from collections import Counter
    norm = lambda t: licenses._WORD.findall(t.lower())
    grams = lambda w: Counter(zip(w, w[1:], strict=False))
    lines, out = (text or "").split("\n"), {}
    for name, t in name_texts:
        b = grams(norm(t))
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                a = grams(norm("\n".join(lines[i : j + 1])))
                total = sum(a.values()) + sum(b.values())
                if total and sum(b.values()):
                    s = 2 * sum((a & b).values()) / total
                    if s >= least:
                        out[name] = max(out.get(name, 0), s)
    return out


def test_licences(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    texts = [
        None, "", "no licence here", "x\nReleased under the MIT License.\ny", "Released under  the\nMIT license", mit, mit.replace("free of charge", "at no charge"),
        "Copyright me\n" + mit + "\ncode()", "licensed under the Apache License, Version 2.0!\nLicensed under CC BY-NC 4.0.", "This work is licensed under the GNU Public License",
        "Licensed under CC BY 4.0. Released under the MIT License.", "Released under the MIT License.\n" * 300, "license " * 5000,
    ]
    docs = spark.createDataFrame([(i, t, "?") for i, t in enumerate(texts)] + [(None, texts[3], "?")], "doc_id long, text string, license string")
    for r in licenses.scan_licenses(docs).collect():
        text = texts[3 if r.doc_id is None else r.doc_id]
        if text and len(text) > 5000:
            continue
        expected = brute(text, licenses.TEMPLATES, 0.8)
        assert r.licenses == sorted(expected), (r, expected)
        assert (r.license is None) == (not expected)
        assert not expected or abs(r.score - max(expected.values())) < 1e-9
    assert licenses.scan_licenses(docs).count() == len(texts) + 1
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_licences_within_lines(spark, tmp_path):
    """Notices inside longer lines, by brute force over all runs of words, through the query."""
    from collections import Counter

    some = words(30, 77)
    texts = [
        "Licensed under CC BY 4.0. Released under the MIT License.", " ".join([*some, "Released under the MIT License.", *some]),
        "(c) 2020 A. Owner. This work is licensed under the GNU General Public License, version 3. All rights kept.", " ".join(some),
        "one\ntwo Licensed under the Apache\nLicense, Version 2.0. three", "Released under the MIT", None, "",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in licenses.op3_license_scan(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        w, best = licenses._WORD.findall((text or "").lower()), {}
        for name, t in licenses.TEMPLATES:
            v = licenses._WORD.findall(t.lower())
            b = Counter(zip(v, v[1:], strict=False))
            for x in range(len(w)):
                for y in range(x + 2, len(w) + 1):
                    a = Counter(zip(w[x:y], w[x + 1 : y], strict=False))
                    s = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                    if s >= 0.8:
                        best[name] = max(best.get(name, 0), s)
        assert found[i].licenses == sorted(best), (text, best)
        assert not best or abs(found[i].score - max(best.values())) < 1e-9
    assert {"CC-BY-4.0", "MIT"} <= set(found[0].licenses) and found[1].licenses == ["MIT"] and "GPL-3.0" in found[2].licenses
    assert (found[4].license, found[4].first_line, found[4].last_line) == ("Apache-2.0", 2, 3)


# ---- preference formatting ------------------------------------------------------------------
def test_preference_pairs(spark):
    schema = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [u, a], [u, b], "?"), (2, [u, a], [u, a], "?"), (3, [u], [u, a], "?"), (4, None, [u], "?"), (5, [], [], "?"), (None, [u, a], [("user", None), a], "?"), (1, [u, a], [u, b], "?")]
    found = preference.format_preferences(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 7
    one = [r for r in found if r.pair_id == 1]
    assert len(one) == 2 and one[0].prompt == "<|im_start|>user\nhi<|im_end|>\n" and one[0].prompt_turns == 1
    assert [(s.text, s.trained) for s in one[0].chosen] == [("<|im_start|>assistant\n", False), ("yes<|im_end|>\n", True)]
    by = {r.pair_id: r for r in found}
    assert by[2].chosen == [] and by[2].rejected == [] and by[2].prompt_turns == 2
    assert by[3].chosen == [] and len(by[3].rejected) == 2
    assert by[4].prompt == "" and by[4].chosen == [] and len(by[4].rejected) == 2
    assert by[None].prompt_turns == 0


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "lost"), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, "assistant", "p"), (3, 1, "assistant", "q")]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    convs = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in preference.conversations(table).collect()}
    assert convs == {1: [("", ""), ("user", "a"), ("assistant", "b")], 2: [("user", "x")] * 2, 3: [("assistant", "p"), ("assistant", "q")]}
    pairs = {r.pair_id: r for r in preference.stale_reply_pairs(table).collect()}
    assert [t.text for t in pairs[3].rejected] == ["p", "p"] and [t.text for t in pairs[1].rejected] == ["", "a", ""]
    assert preference.format_preferences(preference.stale_reply_pairs(table.where("false"))).count() == 0


# ---- near copies ----------------------------------------------------------------------------
def plain_edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_edits():
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint32) for _ in range(2))
        if rng.random() < 0.5:
            b = np.delete(a, [int(rng.integers(0, len(a)))]) if len(a) else a
        for most in (2, 9, 40):
            assert order_minhash.edits(a, b, most) == min(plain_edits(a.tolist(), b.tolist()), most + 1)


def test_near_copies(spark):
    base, other = words(120, 1), words(120, 2)
    passage = words(60, 9)
    texts = {
        0: base, 1: base, 2: changed(base, [3, 70]), 3: changed(base, [10, 40, 90, 110]), 4: other, 5: other[60:] + other[:60],
        6: passage + words(100, 11), 7: passage + words(100, 12), 8: ["a"], 9: ["a"], 10: ["b"], 11: [], 12: [],
    }
    rows = [(i, " ".join(t), 5) for i, t in texts.items()] + [(20 + i, " ".join(passage + words(70, 100 + i)), 5) for i in range(40)]
    rows += [(60 + i, " ".join(changed(base, [i, i + 31])), 5) for i in range(60)] + [(70, " ".join(texts[0]), 5), (200, None, 5), (201, None, 5), (None, "no id", 5), (4, " ".join(other), 5)]
    rows.append((300, " ".join(words(40_000, 30)), 5))
    rows.append((301, " ".join(changed(words(40_000, 30), range(0, 40_000, 400))), 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    found = order_minhash.near_duplicates(docs)
    assert found.count() == len(rows)
    label = {r.doc_id: r.class_id for r in found.collect()}
    for i in [0, 1, 2, 3, *range(60, 120)]:
        assert label[i] == 0
    assert label[4] == 4 and label[5] == 5 and label[6] == 6 and label[7] == 7
    assert [label[i] for i in (8, 9, 10, 11, 12, 200, 201, None)] == [8, 8, 10, 11, 11, 200, 201, None]
    assert [label[20 + i] for i in range(40)] == [20 + i for i in range(40)]
    assert label[300] == label[301] == 300
    kept = order_minhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 4, 5, 200, 201, None}
    assert order_minhash.near_duplicates(docs.where("false")).count() == 0


def test_texts_that_no_tuple_splits(spark, monkeypatch):
    """Unlike texts that agree in all tuples, more than SMALL of them, are compared in full."""
    from pyspark.sql import functions as F

    rows = [(i, " ".join(words(60, 800 + i))) for i in range(11)] + [(20, " ".join(changed(words(60, 807), [30])))]
    sketched = order_minhash._sketched
    alike = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    monkeypatch.setattr(order_minhash, "SKETCHES", 2)
    monkeypatch.setattr(order_minhash, "_sketched", lambda docs: sketched(docs).withColumn("sketch", alike))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert label == {i: i for i in range(11)} | {20: 7}


def test_classes_by_brute_force(spark):
    """Unlike texts around one passage, with near copies among them, over more partitions than some buckets have rows."""
    passage = words(80, 50)
    texts = [passage + words(60 + i % 7, 900 + i) for i in range(40)]
    texts += [changed(texts[i], range(85, 85 + 3 * i, 9)) for i in (3, 8, 13, 21)]
    texts.append(changed(texts[40], [2, 120]))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    ids = {w: i for i, w in enumerate({w for t in texts for w in t})}
    rows = [[ids[w] for w in t] for t in texts]
    want = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if len(set(a) & set(b)) >= 0.75 * max(len(a), len(b)) and 1 - plain_edits(a, b) / max(len(a), len(b)) >= 0.8:
                want = [want[j] if x == want[i] else x for x in want]
    assert len(set(want)) == 40
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()} == dict(enumerate(want))


# ---- repeated passages ----------------------------------------------------------------------
def test_compact_windows_by_brute_force():
    texts = [rng.integers(1, 2**63, n).astype(np.uint64) for n in (49, 50, 51, 200, 330)]
    constant = np.full(300, 7, np.uint64)
    assert len(passages.compact_windows([constant])[0]) <= 2 * passages.HASHES * (300 // passages._BLOCK + 1)
    key, text, at, left, right, number = passages.compact_windows(texts)
    found = {tuple(map(int, x)) for x in zip(text, number, at, left, right, strict=True)}
    expected = set()
    for i, w in enumerate(texts[1:], 1):
        s = np.zeros(len(w) - 4, np.uint64)
        for j in range(5):
            s = s * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - 4 + j]
        s = order_minhash.mixed(s)
        for h in range(passages.HASHES):
            v = s * passages._ODD[h]
            for start in range(len(v) - passages.LEAST + 1):
                c = start + int(np.argmin(v[start : start + passages.LEAST]))
                lo = hi = c
                while lo > 0 and v[lo - 1] > v[c] and c - lo < passages.LEAST - 1:
                    lo -= 1
                while hi < len(v) - 1 and v[hi + 1] >= v[c] and hi - c < passages.LEAST - 1:
                    hi += 1
                if max(c - lo, hi - c) >= passages.BESIDE:
                    expected.add((i, h, c, c - lo, hi - c))
    assert found == expected


@pytest.fixture(scope="module")
def passage_docs(spark):
    p, q = words(55, 50), words(80, 51)
    line = words(20, 52)
    texts = {
        0: words(90, 60) + p + words(30, 61), 1: words(20, 62) + p + words(90, 63), 2: p, 3: words(200, 64), 4: words(70, 65) + changed(q, [40]) + words(10, 66),
        5: q + words(70, 67), 6: words(49, 50), 7: [], 8: words(30, 68) + p[:45] + words(60, 69),
    }
    texts |= {20 + i: line + words(60, 200 + i) for i in range(30)}
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t)), 7) for i, t in texts.items()]
    rows += [(100, None, "en", "s", 0, 7), (None, " ".join(p), "en", "s", 0, 7), (2, " ".join(p), "en", "s", 0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start_word int"), texts


def test_passages(passage_docs):
    docs, texts = passage_docs
    found = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert found.keys() == {1, 2, 5}
    assert (found[1].start_word, found[1].end_word, found[1].source_id) == (20, 75, 0)
    assert (found[2].start_word, found[2].end_word, found[2].source_id) == (0, 55, 0)
    assert found[5].source_id == 4 and found[5].start_word == 0 and found[5].end_word == 80
    assert passages.repeated_passages(docs.where("false")).count() == 0


def test_cut(passage_docs):
    docs, texts = passage_docs
    cut = passages.cut_passages(docs)
    assert cut.columns == docs.columns
    left = {r.doc_id: r for r in cut.collect()}
    assert 2 not in left and left[1].text.split() == texts[1][:20] + texts[1][75:] and left[1].n_chars == len(left[1].text)
    assert left[3].text.split() == texts[3] and None in left and 100 in left


def test_near_passages_behind_a_notice(spark):
    """The least documents of a group hold only a notice of the passage; later ones hold near copies of all of it."""
    rows = []
    for k in range(10):
        passage = words(60, 300 + k)
        for j in range(1 + 11 * (k % 2)):  # beyond SMALL in every second case
            rows.append((100 * k + j, words(70, 5000 + 100 * k + j) + passage[:34] + words(70, 7000 + 100 * k + j)))
        rows.append((100 * k + 50, words(70, 400 + k) + passage + words(70, 500 + k)))
        rows.append((100 * k + 60, words(70, 600 + k) + changed(passage, [45]) + words(70, 700 + k)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    found = {r.doc_id: (r.start_word, r.end_word, r.source_id) for r in passages.repeated_passages(docs).collect()}
    assert found == {100 * k + 60: (70, 130, 100 * k + 50) for k in range(10)}


def test_cut_of_ids_with_several_texts_and_clashing_names(spark):
    p = words(60, 900)
    rows = [(1, " ".join(words(30, 901) + p), "x", 1), (2, " ".join(["aaa", *p, *words(20, 902)]), "x", 1), (2, " ".join(words(5, 903) + ["zz"]), "x", 1), (2, None, "x", 1), (3, " ".join(p), None, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, spans string, doc_id_ int, other int")
    cut = passages.cut_passages(docs)
    assert cut.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in cut.collect()), key=str)
    assert left == sorted([(1, rows[0][1]), (2, " ".join(["aaa", *words(20, 902)])), (2, rows[2][1]), (2, None)], key=str)


def test_planted_passages_are_found(spark):
    """Of near copies planted at random, with Jaccard 0.8 or more, almost all words are found, and nothing in clean texts."""
    r = np.random.default_rng(77)
    rows, planted = [], {}
    for k in range(120):
        size = int(r.choice([55, 80, 150, 300]))
        passage = words(size, 10_000 + k)
        copy = changed(passage, sorted(r.choice(np.arange(10, size - 10), size // 60, replace=False)))
        rows.append((2 * k, words(60, 20_000 + k) + passage + words(60, 30_000 + k)))
        rows.append((2 * k + 1, words(50, 40_000 + k) + copy + words(50, 50_000 + k)))
        planted[2 * k + 1] = (50, 50 + size, 2 * k)
    rows += [(1000 + k, words(200, 60_000 + k)) for k in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    found = {}
    for x in passages.repeated_passages(docs).collect():
        assert x.doc_id in planted and x.source_id == planted[x.doc_id][2] and planted[x.doc_id][0] <= x.start_word < x.end_word <= planted[x.doc_id][1]
        found[x.doc_id] = found.get(x.doc_id, 0) + x.end_word - x.start_word
    assert len(found) >= 0.95 * len(planted)
    assert sum(found.values()) >= 0.93 * sum(b - a for a, b, _ in planted.values())


def test_every_similar_pair_of_a_bucket_with_many_classes_is_found(spark):
    """Half of each text is the same in all: they share buckets by it, and order in them says nothing of the own halves."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(100)]
    rows = []
    for family in range(60):
        own = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        other = list(own)
        for at in rng.sample(range(100), 36):
            other[at] = f"w{rng.randrange(10**9)}"
        rows += [(family, " ".join(common + own)), (100 + family, " ".join(common + other))]
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {n: n % 100 for n, _ in rows}


def test_close_pairs_leave_out_no_similar_pair():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 60, rng.integers(1, 40)).astype("<u4") for _ in range(60)]
    texts += [np.where(rng.random(len(t)) < 0.1, 61, t).astype("<u4") for t in texts] + [np.zeros(300, "<u4"), np.zeros(350, "<u4")]
    shape = np.array([order_minhash._shape(t) for t in texts])
    n, label = np.array([len(t) for t in texts]), np.arange(len(texts)) % 50
    similar = {(i, j) for i in range(len(n)) for j in range(i) if label[i] != label[j] and order_minhash.similarity(texts[i], texts[j], 0.8) >= 0.8}
    for block in (np.zeros(len(n), int), (np.arange(len(n)) >= 70).astype(int)):
        found = {(max(i, j), min(i, j)) for x, y in order_minhash.close_pairs(n, label, block, shape, 0.8) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
        assert found >= {(i, j) for i, j in similar if block[0] == block[-1] or block[i] != block[j]}
        assert all(label[i] != label[j] for i, j in found)
