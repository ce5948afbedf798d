"""Operators against plain versions, on rows with every odd case."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter as Bag
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import chat_formatting, common, decontamination, embedding_join, langid, ngram_join, packing, queries, sanitisation, sharding, sieve, stages, substring_dedup, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, size=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(size)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus():
    base = [words(60 + 7 * i, i) for i in range(8)]
    near = base[0].split()
    near[30] = "changed"
    shared = words(14, 99, 400)
    texts = {
        1: base[0], 2: base[0], 3: " ".join(near), 4: base[1], 5: base[2] + "\n" + shared, 6: shared + " " + base[3], 7: "", 8: None, 9: "one two",
        10: "One  two", 11: "... !!", 12: base[4] * 30, 13: base[5] + " Mail jo.do@mail.example.com or 10.0.0.300, 10.0.0.3; +1 (743) 555-3824; 4111 1111 1111 1111",
        14: "été Übung “quoted” … 12½ " + base[6], 15: "a" * 300, 16: "a" * 120, 17: "\n".join(["same line of words here and there"] * 40), 18: base[7] + " 4111111111111112 x@y.@z.w a@b_c@d.ee",
    }
    rows = [(i, t, "en" if i % 2 else "fr", "s", None if t is None else len(t)) for i, t in texts.items()]
    return [*rows, (3, texts[3], "en", "s", 1), (20, base[1], None, None, None), (21, base[2].upper(), "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names operators use inside
    return spark.createDataFrame(corpus(), SCHEMA).withColumn("key", F.lit("x")).withColumn("n", F.lit(1)).withColumn("h", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", small(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join(spark, docs, nothing):
    many = corpus() + [(100 + i, words(50, 7).replace("e", "e", 1) + f" t{i // 3}", "en", "s", 0) for i in range(40)]
    rows = spark.createDataFrame(many, SCHEMA)
    sets = [(r[0], shingles(r[1])) for r in many]
    links = [(a, b) for a, x in sets for b, y in sets if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    of = components({i for i, _ in sets}, links)
    assert rows_of(ngram_join.ngram_jaccard_join(rows)) == sorted(((i, len(s), of[i]) for i, s in sets), key=repr)
    assert ngram_join.ngram_jaccard_join(nothing).count() == 0
    assert ngram_join.ngram_jaccard_join(docs).count() == docs.count()


def test_hopeless_members_are_left_early(monkeypatch):
    import pyarrow as pa

    looked, plain = [], ngram_join._hits
    monkeypatch.setattr(ngram_join, "_hits", lambda known, grams: looked.append(len(grams)) or plain(known, grams))

    def pairs(hub, members):
        looked.clear()
        members = sorted(members)
        sets = [hub, *members]
        batch = pa.record_batch({"h": [0] * len(sets), "salt": [0] * len(sets), "member": [0] + [1] * len(members), "x": list(range(len(sets))), "n": [len(s) for s in sets], "grams": ngram_join._lists([np.array(s) for s in sets])})
        found = [(r["a"], r["b"]) for out in ngram_join._walk([batch]) for r in out.to_pylist()]
        assert found == [(0, i) for i, m in enumerate(members, 1) if 100 * len(set(hub) & set(m)) >= 80 * len(set(hub) | set(m))]
        return sum(looked)

    hub = list(range(10_000, 10_100))
    far = [list(range(60)) + [1000 * k + j for j in range(40)] for k in range(1, 51)]
    assert pairs(hub, far) <= 100
    near = [list(range(10_000, 10_060)) + [20_000 + 100 * k + j for j in range(40)] for k in range(50)]
    near += [list(range(10_000, 10_095)) + [90_000 + k] for k in range(5)]
    assert pairs(hub, near) <= 50 * 32 + 5 * 100
    rng = random.Random(2)
    pairs(hub, [sorted(rng.sample(range(9_990, 10_110), rng.randint(70, 110))) for _ in range(200)])


def test_decontamination(spark, docs, nothing):
    shared = corpus()[4][1].split("\n")[1]
    items = [(1, shared.upper() + "."), (2, "nowhere " * 12), (3, "one two"), (4, None), (5, ""), (None, shared), (10, shared[3:])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("w", F.lit(0))
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for i, t in items:
        w = find(small(t))
        if w and i is not None:
            for j in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    want = []
    for r in corpus():
        w, hit, found = find(small(r[1])), set(), set()
        for x, ids in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    found |= ids
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    assert sum(x[-1] for x in want) >= 3
    assert rows_of(decontamination.decontaminate(docs, bench).drop("key")) == sorted(want, key=repr)
    near = decontamination.proximity_matches(docs, bench, slack=3)
    assert {(5, 1), (6, 1)} <= set(rows_of(near))
    assert decontamination.decontaminate(nothing, bench).count() == 0
    assert not decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count()


def test_near_copies_are_nodes_once_not_below_each_gram(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(words[:7 * i] + [f"own{i}"] + words[7 * i + 1 :])) for i in range(40)]
    staged, plain = {}, ngram_join.stage

    def counted(df, label):
        out = plain(df, label)
        staged[label] = staged.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "stage", counted)
    found = ngram_join.ngram_jaccard_join(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {r["component_id"] for r in found.collect()} == {0}
    assert staged["nodes"] < 40 * 20  # each set has about 60 leading grams


def test_a_written_step_leaves_no_shuffle_files(spark):
    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for top in places for f in Path(top).rglob("shuffle_*.data")}
    before = shuffled()
    df = spark.range(20000).groupBy((F.col("id") % 5000).alias("k")).count()  # held, so that no collector may let its plan go
    written = common.stage(df, "held")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert written.count() == df.count() == 5000


def test_counted_keys_are_added_up_in_little_memory():
    held, rng = sieve.Tally(), np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 1 << 40, 100_000).astype(np.uint64)) for _ in range(9)]
    for part in [*parts, parts[0]]:
        held.add(part)
    keys, counts = np.unique(np.concatenate([*parts, parts[0]]), return_counts=True)
    held_before = held.size
    tracemalloc.start()
    got = held.total()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[0] == keys).all() and (got[1] == counts).all()
    assert peak < 44 * held_before  # bytes for each key, beside the 16 held



@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_dedup(docs, nothing, hot):
    first = {}
    for i, t, *_ in corpus():
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(first.get(b[j : j + 50], i), i)
    want = []
    for i, t, *_ in corpus():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert rows_of(substring_dedup.substring_dedup(docs, hot)) == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_window_classes_follow_the_suffix_order():
    rng = np.random.default_rng(3)
    strings = rng.integers(0, 2, (200, 14)).astype(np.uint8)
    ids = rng.integers(0, 50, 200)
    got = substring_dedup.smallest_by_window(strings, ids, 6)
    for j in range(9):
        for i in range(200):
            same = (strings[:, j : j + 6] == strings[i, j : j + 6]).all(axis=1)
            assert got[i, j] == ids[same].min()


def test_anchors_of_long_texts_are_those_of_their_pieces(monkeypatch):
    text = words(4000, 5).encode()
    whole = substring_dedup.anchors([text])[0]
    monkeypatch.setattr(substring_dedup, "_PIECE", 1000)
    cut = substring_dedup.anchors([text])[0]
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def brute_base(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for no, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            octets = kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))
            ok = {"email": True, "ip": octets, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def test_personal_data(spark, docs, nothing):
    odd = ["a@b.c_d@e.f", "x" * 50_000 + "@", "1" * 40_000, "1.2.3.45.6.7.8 000.0.0255.1", "+1-2 +12345678901234567890", "ü 4111-1111-1111-1111 ü a.b@c.d.e-", "12 3456789012345 6789"]
    rows = [(i, t) for i, t, *_ in corpus()] + [(1000 + i, t) for i, t in enumerate(odd)]
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in sanitisation.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = set()
    for i, t in rows:
        spans = brute_base(t or "")
        n = Bag(s[3] for s in spans)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.add((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    assert sanitisation.personal_data(nothing).count() == 0
    clean = {r["doc_id"]: r for r in sanitisation.sanitised(docs).collect()}
    assert "[EMAIL]" in clean[13]["text"] and "[CARD]" in clean[13]["text"] and clean[13]["key"] == "x" and clean[8]["text"] is None
    assert clean[12]["text"] == corpus()[11][1]


def test_disclosing_terms(spark):
    rows = [(i, f"{words(5, i)} secretname wrote to jo@mail.com {words(5, i + 50)}") for i in range(6)] + [(100 + i, words(30, i)) for i in range(5)]
    rows = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [r["spans"] for r in sanitisation.personal_data(rows).where("doc_id < 100").collect()]
    assert all("term:" in s and "email:" in s for s in found)
    text = sanitisation.sanitised(rows).where("doc_id = 0").first()["text"]
    assert "secretname" not in text and "[EMAIL]" in text


def test_sharding(docs, nothing):
    out = sharding.feistel_shards(docs).collect()
    n = len(corpus())
    sizes = Bag(r["shard"] for r in out)
    assert len(out) == n and max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s])) for s in range(16))
    want = Bag((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Bag((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.feistel_shards(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 1021])
def test_permutation(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "row")
    got = [r["p"] for r in sharding.permuted(rows, n, sharding.walk_length(spark, n)).collect()]
    assert sorted(got) == list(range(n))


def best_fit(histogram, capacity):
    import bisect

    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = bisect.bisect_left(rooms, length)
            room = rooms.pop(i) if i < len(rooms) else capacity
            bisect.insort(rooms, room - length)
    return rooms


def test_best_fit_runs():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([8, 10, 17, 50])
        histogram = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        filled = {}
        for length, _, pieces, first, each, offset in packing.best_fit_runs(histogram, capacity):
            for j in range(pieces):
                assert filled.get(first + j // each, 0) == offset + j % each * length
                filled[first + j // each] = offset + (j % each + 1) * length
        assert sorted(capacity - f for f in filled.values()) == best_fit(histogram, capacity)


def test_packing(docs, nothing):
    path = queries.tokenizer_path(queries.PACKING_TOKENIZER)
    out = packing.best_fit_packing(docs, path, 64).collect()
    tokenizer = packing.WordIds(path).tokenizer
    want, histogram = Bag(), Bag()
    for i, t, *_ in corpus():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want[(i, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
            histogram[len(part)] += 1
    assert Bag(tuple(r)[:5] for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    assert len(sequences) == len(best_fit(histogram, 64))
    assert packing.best_fit_packing(nothing, path).count() == 0


def test_odd_words_are_tokenised_as_by_the_tokenizer():
    ids = packing.WordIds(queries.tokenizer_path(queries.PACKING_TOKENIZER))
    odd = ["It's “quoted”… Éá ΑΣ.Β ΑΣ 12½ İstanbul", "", "  \n", "a<|endoftext|>b ABC'LL '' ...'s", "\x1c a\x85b ſ K", "日本語 テスト 1２3", "é'd"]
    want = [np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert ids([t.encode() for t in odd]) == want


def plain_bits(train, text):
    counts = [{} for _ in range(langid.ORDER + 1)]
    for t in train:
        b = langid._START + t.translate(langid._PLAIN)
        for i in range(langid.ORDER, len(b)):
            for k in range(langid.ORDER + 1):
                own = counts[k].setdefault(b[i - k : i], {})
                own[b[i]] = own.get(b[i], 0) + 1
    b, bits = langid._START + text.translate(langid._PLAIN), 0.0
    for i in range(langid.ORDER, len(b)):
        excluded = set()
        for k in range(langid.ORDER, -1, -1):
            own = counts[k].get(b[i - k : i])
            if own is None:
                excluded = set()
                continue
            left = {s: n for s, n in own.items() if s not in excluded}
            if b[i] in left:
                bits -= math.log2(left[b[i]] / (sum(left.values()) + len(left)))
                break
            if left:
                bits -= math.log2(len(left) / (sum(left.values()) + len(left)))
            excluded = set(own)
        else:
            bits += math.log2(256 - len(excluded))
    return bits


def test_code_lengths_are_exact():
    train = [b"the cat sat on the mat", "déjà vu là bas".encode(), b"the theory of that"]
    codes, counts = np.unique(np.concatenate([langid.grams([t])[0] for t in train]), return_counts=True)
    model = langid.Model(["x"], np.zeros(len(codes), int), codes, counts.astype(float))
    texts = [b"the hat", "zéro qqq that".encode(), b"", b"Z", "漢字 the".encode(), b"the mat sat there, 12"]
    assert np.allclose(model.code_lengths(texts)[:, 0], [plain_bits(train, t) for t in texts], atol=1e-3)


def test_language_id(spark, sf_dir, docs, nothing):
    out = langid.predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    told = out.join(truth, "doc_id").where("held_out")
    assert told.where("lang_pred = lang").count() >= 0.95 * told.count() > 0
    odd = {r["doc_id"]: r for r in langid.predict_languages(docs).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (7, 8, 11)) and odd[1]["lang_pred"] in ("en", "fr")
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in odd.items())
    assert langid.predict_languages(nothing).count() == 0


def test_embedding_join(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * (0.12 if i % 2 else 0.02)).tolist(), i % 3) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(5)] + [(400, [2 * x for x in rows[0][1]], 0), (401, rows[0][1], None), (402, None, 0), (403, [0.0] * 8, 0)]
    rows += [(404, [float("nan")] * 8, 0), (405, [float("inf")] + [1.0] * 7, 0), (406, [None] + [1.0] * 7, 0), (407, [], 0), (408, [1.0] * 3, 0)]
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if label is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    label = {r[0]: r[2] for r in rows}
    links = [(a, b) for a in good for b in good if a != b and label[a] == label[b] and good[a] @ good[b] >= 0.98]
    of, n = components({r[0] for r in rows}, links), Bag(a for a, _ in links)
    schema = "vec_id bigint, embedding array<double>, label int"
    got = rows_of(embedding_join.epsilon_grid_join(spark.createDataFrame(rows, schema)))
    assert len(links) > 500 and got == sorted(((r[0], n[r[0]], of[r[0]], of[r[0]] == r[0]) for r in rows), key=repr)
    assert embedding_join.epsilon_grid_join(spark.createDataFrame([], schema)).count() == 0


def test_vectors_of_any_length_and_magnitude(spark):
    rng = np.random.default_rng(6)
    base = {w: rng.normal(size=(4, w)) for w in (3, 5, 8)}
    rows = [(k, (v * 10.0 ** e).tolist(), "a") for k, (v, e) in enumerate((base[w][i] + rng.normal(size=w) * 0.01, e) for w in base for i in range(4) for e in (0, 200, -200, 300, -310))]
    rows += [(900, [1e200, 2e200], "a"), (901, [1e200, 2e200], "a"), (902, [5e-324, 1e-323], "a"), (903, [1.0, 2.0], "b"), (904, [3.0], "a"), (905, [4.0], "a"), (906, [-4.0], "a")]
    unit = {}
    for i, v, _ in rows:
        x = np.array(v) / np.abs(v).max()
        unit[i] = x / np.linalg.norm(x)
    label = {i: g for i, _, g in rows}
    links = [(a, b) for a in unit for b in unit if a != b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    of, n = components(set(unit), links), Bag(a for a, _ in links)
    got = rows_of(embedding_join.epsilon_grid_join(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")))
    assert n[900] == 2 and n[904] == 1 and n[0] >= 3
    assert got == sorted(((i, n[i], of[i], of[i] == i) for i in unit), key=repr)


def test_blocks_of_an_embedding_join(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(150, 6))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    monkeypatch.setattr(embedding_join, "LEAF", 8)
    links = embedding_join._Links(np.eye(6)[:, :3], float(np.sqrt(2 - 2 * 0.9)), 0.9)
    got = {(int(x), int(y)) for xs, ys in links.join(a, a, True) for x, y in zip(xs, ys)}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(a @ a.T >= 0.9)) if i < j}


def test_token_trees_follow_edits():
    import public_tokenizers

    counter = token_counts.Counter(queries.tokenizer_path(queries.COUNTING_TOKENIZER), public_tokenizers.PATTERN)
    tokens = lambda t: len(counter.encoding.encode_ordinary(t))
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b ", " ", "\n", "é", "  x", "the ", " 12", "'s", " ", "!"]) for _ in range(rng.randint(0, 40)))
        edits, at = [], 0
        while rng.random() < 0.6 and at <= len(text):
            start = rng.randint(at, len(text))
            edits.append((start, rng.randint(start, min(len(text), start + 5)), rng.choice(["", " ", "X", " y\n", "\n "])))
            at = edits[-1][1] + 1
        want = text
        for start, end, put in reversed(edits):
            want = want[:start] + put + want[end:]
        tree = token_counts.TokenTree(text, counter)
        assert tree.total() == tokens(text) and tree.apply(edits) == want and tree.total() == tokens(want)


def test_edited_token_counts(spark, docs, nothing):
    import public_tokenizers

    spans = sanitisation.base_spans(sanitisation.text_rows_of(docs)).select("doc_id", "key", "start", "end", F.lit("[X]").alias("put"))
    path = queries.tokenizer_path(queries.COUNTING_TOKENIZER)
    counter = token_counts.Counter(path, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in token_counts.edited_token_counts(docs, spans, path, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in corpus():
        text = t or ""
        assert got[i]["n_tokens"] == len(counter.encoding.encode_ordinary(text))
        if i == 13:
            for a, _, b, _ in reversed(brute_base(text)):
                text = text[:a] + "[X]" + text[b:]
        if i != 18:
            assert got[i]["n_tokens_after"] == len(counter.encoding.encode_ordinary(text))
    assert got[13]["n_edits"] == 4
    assert token_counts.edited_token_counts(nothing, spans, path, public_tokenizers.PATTERN).count() == 0
    # edits found in the row and edits that come by a join count the same
    put = dict.fromkeys(sanitisation.REPLACED, "[X]")
    in_place = token_counts.replaced_token_counts(docs, put, path, public_tokenizers.PATTERN)
    assert Bag(map(tuple, in_place.collect())) == Bag(map(tuple, token_counts.edited_token_counts(docs, spans, path, public_tokenizers.PATTERN).collect()))
    assert token_counts.replaced_token_counts(nothing, put, path, public_tokenizers.PATTERN).count() == 0


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "What is  Spark?\nTell me more."), (1, 1, "assistant", "> what is spark?\nAn engine."), (1, 2, "user", "A new topic"),
        (1, 3, "user", "> > what is spark?\n> An engine.\nThanks"), (1, 4, None, ">> An Engine.\nnested only"), (1, 5, "user", "> unknown words\nhm"),
        (2, 0, "user", "> What is Spark?\nother conversation"), (2, 0, "user", "> What is Spark?\nother conversation"), (None, 1, "user", "> x"), (3, 0, "user", None), (3, 1, "user", ""),
    ]
    schema = "conv_id bigint, turn bigint, role string, text string"
    messages = spark.createDataFrame(rows, schema).withColumn("level", F.lit(1))
    out = Bag((r["conv_id"], r["turn"], r["parent_turn"], r["root_turn"], r["n_quoted"], r["n_linked"]) for r in chat_formatting.linked_conversations(messages).collect())
    assert out == Bag(
        [(1, 0, None, 0, 0, 0), (1, 1, 0, 0, 1, 1), (1, 2, None, 2, 0, 0), (1, 3, 1, 0, 2, 2), (1, 4, 1, 0, 1, 1), (1, 5, None, 5, 1, 0)]
        + [(2, 0, None, 0, 1, 0)] * 2 + [(None, 1, None, 1, 1, 0), (3, 0, None, 0, 0, 0), (3, 1, None, 1, 0, 0)]
    )
    said = chat_formatting.linked_conversations(messages).where("conv_id = 1 and turn = 3").first()["formatted"]
    assert said == "<|user|>\nThanks"
    assert chat_formatting.linked_conversations(messages.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = function(spark, docs, sf_dir)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == set(before)
            break
        assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "language_id":
            assert set(after) == {i for i, r in before.items() if r["text"] and any(map(str.isalpha, r["text"]))}
        elif name == "near_duplicates":
            sets = [(i, shingles(r["text"])) for i, r in before.items()]
            links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
            assert set(after) == set(components(before, links).values())
        elif name == "decontamination":
            assert 0 < len(after) < len(before)
        else:
            assert set(after) == set(before) and not any(brute_base(r["text"]) for r in after.values())
        docs = spark.createDataFrame([tuple(r) for r in after.values()], out.schema)


CLASHES = ("o_id", "o_key", "o_row", "o_copies", "bad_id", "bad_key", "key", "row", "cuts", "last", "score", "lang_pred", "held_out", "component", "n", "kind", "match", "bits", "t", "w")


def test_stages_leave_other_columns_alone(spark, sf_dir):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in corpus()] + [(None, words(50, 77), "en", "s", 1), (30, words(30000, 78), "fr", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(f"{c}-"), F.xxhash64("doc_id", "text").cast("string")) for c in CLASHES})
    expect = {r["key"].split("-", 1)[1]: r for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        found = out.collect()
        assert found
        for r in found:
            own = r["key"].split("-", 1)[1]
            assert all(r[c] == f"{c}-{own}" for c in CLASHES) and r["source"] == expect[own]["source"], name
        assert function(spark, docs.limit(0), sf_dir).columns == docs.columns
        docs = spark.createDataFrame(found, out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns[:2] == ["doc_id", "piece"]


def test_without_labels_all_texts_with_letters_stay(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 1), (None, "é", None, "s", 1)], SCHEMA)
    out = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert rows_of(out) == rows_of(docs.where("doc_id = 1 or doc_id is null"))


def test_one_long_text_does_not_fill_the_sample(spark):
    rows = [(i, words(40, i), "en") for i in range(300)] + [(i, words(40, 1000 + i), "fr") for i in range(300, 330)]
    schema = "doc_id bigint, text string, lang string"
    plain = langid.fit(spark.createDataFrame(rows, schema))
    long = langid.fit(spark.createDataFrame([(i, words(400000, i) if i % 5 == 0 else t, lang) for i, t, lang in rows], schema), sample_bytes=300_000)
    assert len(long.trees[0].grams[3][0]) > 0.5 * len(plain.trees[0].grams[3][0])
    alone = langid.fit(spark.createDataFrame([(1, words(400000, 1), "en"), (3, words(400000, 2), "en")], schema), sample_bytes=10)
    assert sum(t.grams[0][1].sum() for t in alone.trees) <= 4 * langid.SAMPLE_SPAN


def test_one_row_of_each_group_stays(spark):
    a, b, c, d, e = (words(60, 200 + i) for i in range(5))
    near = lambda t: " ".join(["changed", *t.split()[1:]])
    texts = [
        (3, a), (5, near(a)), (5, b), (7, c), (7, near(c)), (9, d), (9, d), (9, d), (None, near(a)), (None, e), (None, near(e)), (None, e),
        (8, ""), (8, ""), (None, None), (None, None), (11, None), (3, "..."), (12, b.upper()),
    ]
    rows = [(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(texts)]
    out = stages.one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()
    sets = [shingles(t) for _, t in texts]
    links = [(x, y) for x, s in enumerate(sets) for y, r in enumerate(sets) if s and r and 100 * len(s & r) >= 80 * len(s | r)]
    of = components(range(len(texts)), links)
    got = Bag(of[int(r["source"][1:])] for r in out)
    assert got == Bag(set(of.values()))
    for r in out:
        k = int(r["source"][1:])
        assert tuple(r) == rows[k]
        ids = [texts[j][0] for j in of if of[j] == of[k]]
        assert r["doc_id"] == min((i for i in ids if i is not None), default=None)
    assert (5, b) in {(r["doc_id"], r["text"]) for r in out}


def test_added_tokens_are_tokenised_as_by_a_fresh_tokenizer(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.PACKING_TOKENIZER)
    fresh = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>one two<|endoftext|>" * 40, "<|ENDOFTEXT|> x", "<|endoftext", "plain words", "<|<|endoftext|>|>", "é<|startoftext|>É “", None]
    ids = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 49407 in ids[0] and packing.WordIds(path)([(t or "").encode() for t in texts]) == [np.array(i, "<u4").tobytes() for i in ids]
    out = packing.best_fit_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, 16).collect()
    pieces = [(k, n, at, i[at : at + 16]) for k, i in enumerate([*i, 0] for i in ids) for n, at in enumerate(range(0, len(i), 16))]
    assert Bag(tuple(r)[:5] for r in out) == Bag((k, n, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, n, at, p in pieces)


def test_altered_passages_are_near(spark, tmp_path):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    rng, passage = random.Random(8), words(14, 301, 400).split()
    items = [(1, " ".join(passage)), (2, "rarename won the great prize of science twice"), (3, "solo"), (4, "go go go go"), (5, words(6, 302, 400)), (None, "solo"), (6, "nowhere " * 9)]
    altered = ["othername" if i % 6 == 3 else w for i, w in enumerate(passage)]
    texts = [
        "x y " + " ".join(altered), "In 1903 Uniquename won the great prize of science twice.", "a SOLO part", "go on", "go, go, go, go",
        " ".join(passage[:4] + ["and", "then"] + passage[4:]), " ".join(reversed(passage)), "won the prize", None, "", words(40, 303),
    ]
    texts += [" ".join(rng.choice([*passage, *"abc"]) for _ in range(60)) for _ in range(30)]
    texts += [" ".join(w if rng.random() < 0.75 else rng.choice("abc") for w in passage[rng.randint(0, 4) :]) for _ in range(40)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts, 1)]
    want = []
    for i, t in rows:
        w, near = find(small(t)), set()
        if not small(t)[:1].isalnum():
            w = ["", *w]
        for item, text in items:
            b = find(small(text))
            for at in range(max(1, len(b) - 9)) if item is not None else ():
                x = b[at : at + 10]
                hits = [(p - o, o, p) for o, a in enumerate(x) for p, c in enumerate(w) if a == c]
                need = -(-4 * len(x) // 5)
                for s, *_ in hits:
                    here = [h for h in hits if s <= h[0] <= s + decontamination.SLACK]
                    if min(len({h[1] for h in here}), len({h[2] for h in here})) >= need:
                        near.add(item)
        want.append((i, len(near), hashlib.sha256(",".join(sorted(map(str, near))).encode()).hexdigest()))
    assert [x[1] for x in want[:6]] == [1, 1, 1, 0, 1, 1] and 3 < sum(x[1] for x in want[11:41]) + sum(x[1] for x in want[41:])
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.op2_benchmark_decontamination(spark, str(tmp_path))
    assert rows_of(out.select("doc_id", "n_near_items", "near_items_sha256")) == sorted(want, key=repr)


def test_terms_of_entities_seen_once(spark):
    common = "we all met in the old hall and then"
    once = f"{common} Zyxwname \u674e \u674e\u660e wrote from solo@mail.com {common}"
    cut = "abcdefghijkl " + "the " * 28 + "x@mail.com " + "the " * 28 + "mnopqrstuvw"
    rows = [(1, once), (2, cut), (3, "abcdef here"), *((10 + i, f"{common} wrote from {words(9, i)}") for i in range(20)), (4, "quux to twice@mail.com"), (4, "quux to twice@mail.com"), (5, "quux")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    n = Bag(w for t in {r for r in rows} for w in set(re.findall(r"[^\W\d_]+", t[1].lower())))
    text_rows = sanitisation.text_rows_of(frame)
    spans = sanitisation.base_spans(text_rows)
    names = {r["e"]: r["match"] for r in spans.select(sanitisation.entity().alias("e"), "match").collect()}
    got = {(names[r["e"]], r["term"]): r["bits"] for r in sanitisation.disclosing_terms(text_rows, spans).collect()}
    want = {("solo@mail.com", w): math.log2((n[w] + 1) / 1) for w in ("zyxwname", "\u674e", "\u674e\u660e")} | {("twice@mail.com", "quux"): math.log2(3)}
    # of the twelve letters at the edge nine would be inside: no word of the text, so no term
    want |= {("twice@mail.com", "to"): math.log2(n["to"] + 1)}
    assert got == pytest.approx(want)
    clean = {r["doc_id"]: r["text"] for r in sanitisation.sanitised(frame).collect()}
    assert "Zyxwname" not in clean[1] and "\u674e" not in clean[1] and common in clean[1]
    assert "abcdefghijkl" in clean[2] and "mnopqrstuvw" in clean[2] and "q* to [EMAIL]" not in clean[5]


def test_variants_of_a_text_that_are_not_linked_are_not_compared_one_by_one(spark, monkeypatch):
    rng, base = random.Random(5), [f"w{i}" for i in range(150)]

    def variant(i):
        own = list(base)
        for j in range(rng.randint(1, 6)):
            own[rng.randrange(150)] = f"own{i}x{j}"
        return " ".join(own)

    texts = [(i, variant(i)) for i in range(300)]
    sets = [(i, shingles(t)) for i, t in texts]
    links = [(a, b) for a, x in sets for b, y in sets if 100 * len(x & y) >= 80 * len(x | y)]
    of = components({i for i, _ in sets}, links)
    assert 60 < len(set(of.values())) < 270
    last, met, plain = {}, [], ngram_join.stage

    def counted(df, label):
        out = plain(df, label)
        last[label] = out
        if label == "hubs":
            met.append(last["nodes"].select("node").join(out, "node").count())
        return out

    monkeypatch.setattr(ngram_join, "stage", counted)
    found = ngram_join.ngram_jaccard_join(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert rows_of(found) == sorted(((i, len(s), of[i]) for i, s in sets), key=repr)
    assert sum(met) < 300 * 60, met
