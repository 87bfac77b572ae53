"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import (
    bin_slack,
    embed_lsh,
    exact_dedup,
    linear_svm,
    lm_lattice,
    minhash_fss,
    pfair,
    quality_nbsvm,
    suffix_dedup,
    token_counts,
    toxicity_ssk,
)
from tessera.llm.common import id_crc
from tessera.llm.components import connected_components
from tessera.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from tessera.operators import resolution

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("ra", "ven", "dol", "pik")]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 60))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def odd_rows():
    """Copies, near copies, nulls, empties, a long text, equal ids."""
    base = texts(12)
    rows = list(enumerate(base))
    rows += [(20, base[0]), (21, base[0].upper()), (22, base[1] + " tail"), (23, None), (24, ""), (25, "   "), (26, "one"), (27, "ONE"), (28, "kara " * 9000)]
    return rows + [(5, base[5]), (None, "no id here at all"), (30, "É" + base[2]), (31, "é" + base[2])]


def sha_low(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return hashlib.sha256(low.encode()).hexdigest()


def test_exact_groups(spark, odd_rows):
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[sha_low(t)].append(i)
    want = sorted((str(i), str(max((x for x in groups[sha_low(t)] if x is not None), default=None)), len(groups[sha_low(t)])) for i, t in odd_rows)
    got = exact_dedup.exact_groups(frame(spark, odd_rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want
    kept = exact_dedup.deduplicate(frame(spark, odd_rows).withColumn("kept", F.lit(1)).withColumn("_h", F.lit(2)))
    assert kept.count() == len(groups) and kept.columns[-2:] == ["kept", "_h"]
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_exact_groups_without_a_broadcast(spark, odd_rows):
    rows = odd_rows + [(100 + i, f"text {i % 700}") for i in range(900)]
    a = exact_dedup.exact_groups(frame(spark, rows)).select("doc_id", "keep_id", "group_size").collect()
    b = exact_dedup.exact_groups(frame(spark, rows), broadcast_bytes=0).select("doc_id", "keep_id", "group_size").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(a, key=key) == sorted(b, key=key)


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(rows):
    """Least reachable id of every id, rows of one id together; by all pairs of texts."""
    sets, parent = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        both = len(x & y)
        if both and 100 * both >= 75 * (len(x) + len(y) - both):
            u, v = find(a), find(b)
            parent[max(u, v)] = min(u, v)
    return {i: find(i) for i in parent}


def test_near_groups(spark, odd_rows):
    rng, rows = random.Random(4), [r for r in odd_rows if r[0] is not None]
    base = texts(1, 9)[0].split() * 3
    for i in range(60):  # one large group whose members lie on both sides of the threshold
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(99))
        rows.append((200 + i, " ".join(w)))
    far = texts(6, 77)
    # one id with several texts, each of them near to another document
    rows += [(300, far[0]), (300, far[1]), (300, far[2]), (301, far[0] + " a"), (302, far[1] + " b"), (299, far[2] + " c"), (304, far[3]), (305, far[3])]
    want = components_of(rows)
    odd = frame(spark, rows).withColumn("sketch", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = minhash_fss.near_groups(odd).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and want[300] == want[302] == 299
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingle_set(t))) for i, t in rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    left = minhash_fss.deduplicate(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == set(want.values())
    assert minhash_fss.near_groups(frame(spark, [])).count() == 0
    nameless = minhash_fss.near_groups(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")]))
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in nameless.collect()) == [("1", "1", True), ("1", "1", True), ("None", "None", True)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_statement(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert Counter(map(tuple, QUERIES[name](spark, sf).select(*names).collect())) == Counter(want.fetchall())


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    for size in (1, 3, 400):
        assert np.count_nonzero(minhash_fss.sketch(np.unique(x[:size]))) == 128
    agree = [(minhash_fss.sketch(np.unique(a[:700])) == minhash_fss.sketch(np.unique(a[100:]))).mean() for a in (rng.integers(0, 2**63, 800).astype(np.uint64) for _ in range(20))]
    assert abs(np.mean(agree) - 600 / 800) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_shuffled_chain(spark):
    ids = np.random.default_rng(0).permutation(3000).tolist()
    edges = list(zip(ids, ids[1:], strict=False))
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == 3000 and {r["component"] for r in got} == {0}
    linked = spark.createDataFrame([(v, e) for e, ends in enumerate(edges) for v in ends], "record long, identifier long")
    got = resolution.components(linked).collect()
    assert len(got) == 3000 and {r["component"] for r in got} == {0}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + 0.25 * rng.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [], 0), (206, rows[0][1][:8], 0), (207, rows[0][1], 1), (208, [x * 1e30 for x in rows[0][1]], 0)]
    ok = {i: (np.array(v), y) for i, v, y in rows if y is not None and v and np.isfinite(v).all() and any(v)}
    links = {i: 0 for i, _, _ in rows}
    parent = {i: i for i in links}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        (x, p), (y, q) = ok[a], ok[b]
        if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            links[a] += 1
            links[b] += 1
            u, v = find(a), find(b)
            parent[max(u, v)] = min(u, v)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("w", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = embed_lsh.near_vectors(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (links[i], find(i)) for i in links}
    assert embed_lsh.near_vectors(df.where("false")).count() == 0
    east, north = [1.0, 0.0], [0.0, 1.0]
    again = [(1, east, 0), (1, north, 0), (2, east, 0), (None, north, 0), (3, north, 0), (None, east, 5)]
    got = embed_lsh.near_vectors(spark.createDataFrame(again, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [
        ("1", 1, "1", True), ("1", 2, "1", True), ("2", 1, "1", False), ("3", 2, "1", False), ("None", 0, "None", True), ("None", 2, "1", False)
    ]


def test_vector_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (np.ones(8) + 0.1 * rng.standard_normal(8)).tolist(), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = {r["vec_id"]: r["n_links"] for r in embed_lsh.near_vectors(df).collect()}
    monkeypatch.setattr(embed_lsh, "BLOCK", 7)
    assert {r["vec_id"]: r["n_links"] for r in embed_lsh.near_vectors(df, bits=2).collect()} == whole


def deviation(order, weights):
    """Largest difference of any source's share of a prefix from its target, in blocks."""
    total, seen, most = sum(weights.values()), Counter(), 0.0
    for t, s in enumerate(order, 1):
        seen[s] += 1
        most = max(most, *(abs(seen[x] - w * t / total) for x, w in weights.items()))
    return most


def test_pfair_is_exact():
    rng = random.Random(2)
    for _ in range(40):
        units = {str(i): rng.randint(1, 30) for i in range(rng.randint(1, 8))}
        places, length = pfair.period(units)
        order = sorted((p, s) for s, ps in places.items() for p in ps)
        assert length == len(order) == sum(units.values()) and deviation([s for _, s in order], units) < 1
    assert pfair.units_of({"a": 5, "b": 1, "c": 1}) == {"a": 5, "b": 1, "c": 1} and pfair.units_of({"a": 0.35, "b": 0.0005}) == {"a": 700, "b": 1}
    for weights in ({"a": 5, "b": 1, "c": 1}, {"a": 0.0004, "b": 0.6, "c": 0.3996}, {str(i): i + 0.123 for i in range(40)}):
        units, blocks = pfair.units_of(weights), {s: 10**6 for s in weights}
        placed = pfair.phases({s: 3000 for s in weights}, units)
        first = {}
        for s, at, end, start, u, length, places in placed:
            for k in range(end - at):
                first[start + k // u * length + places[k % u]] = s
        assert sorted(first) == list(range(3000 * len(weights)))  # every block has a slot of its own
        until = min(start for _, _, _, start, *_ in placed if start) if any(p[3] for p in placed) else len(first)
        assert deviation([first[t] for t in range(until)], weights) < 1
        head = [s for s, _ in itertools.islice(pfair.one_pass(blocks, units), 20_000)]
        assert deviation(head, weights) < 1 + 1e-6
    ended = list(pfair.one_pass({"a": 3, "b": 50, "c": 2}, {"a": 1, "b": 2, "c": 0}))
    assert Counter(s for s, _ in ended) == {"a": 3, "b": 50, "c": 2} and {s for s, _ in ended[-2:]} == {"c"}


def test_pfair(spark):
    rows = [(i, None, None, f"s{i % 3}" if i % 7 else None, None) for i in range(300)] + [(5, None, None, "s2", None)]
    df = spark.createDataFrame(rows, DOC).withColumn("slot", F.lit("x")).withColumn("block", F.lit("y"))
    for sources in (1000, 2):  # phases, and one pass for many sources
        got = pfair.schedule(df, {"s0": 3, "s1": 1, "s2": 1, "": 1}, block_rows=4, broadcast_sources=sources).collect()
        assert len(got) == 301 and len({r["position"] for r in got}) == 301
        blocks = {r["slot"]: r["source"] for r in got}
        assert sorted(blocks) == list(range(len(blocks)))
        assert deviation([blocks[t] for t in range(20)], {"s0": 3, "s1": 1, "s2": 1, "": 1}) < 1
        late = pfair.schedule(df, {"s0": 1}, block_rows=4, broadcast_sources=sources).collect()
        assert max(r["slot"] for r in late if r["source"] == "s0") < min(r["slot"] for r in late if r["source"] != "s0")
    mixed = pfair.mixed(df, block_rows=4)
    assert mixed.columns == df.columns and Counter(map(tuple, mixed.collect())) == Counter(map(tuple, df.collect()))
    assert pfair.schedule(df.where("false")).count() == 0 and pfair.schedule(df.where("false"), broadcast_sources=-1).count() == 0
    with pytest.raises(ValueError, match="negative"):
        pfair.units_of({"a": -1})


def test_packing_keeps_the_mix(spark, tmp_path, monkeypatch):
    """A prefix of the sequences holds the sources as their weights say, up to one stretch."""
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 400))), "en", "big" if i % 10 else "small", 0) for i in range(1500)]
    source = {i: s for i, _, _, s, _ in rows}
    monkeypatch.setattr(bin_slack.pack_in_order, "__defaults__", (64, *bin_slack.pack_in_order.__defaults__[1:]))
    pfair.mixed(spark.createDataFrame(rows, DOC), {"big": 1, "small": 1}, block_rows=4).write.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).collect()
    plain = bin_slack.pack(spark.createDataFrame(rows, DOC), tokenizer_file("word_bpe_49k.json")).collect()
    shown = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r[c] for c in shown) for r in got) == Counter(tuple(r[c] for c in shown) for r in plain)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
    for pieces in bins.values():
        assert sorted(pieces)[0][0] == 0 and all(o + n == p for (o, n, _), (p, _, _) in zip(sorted(pieces), sorted(pieces)[1:], strict=False))
        assert sum(n for _, n, _ in pieces) <= 4096
    seen, taken = Counter(), set()
    for sequence in sorted(bins):
        for _, _, d in bins[sequence]:
            if d not in taken:
                taken.add(d)
                seen[source[d]] += 1
        if 64 <= len(taken) <= 250:  # the small source lasts for 300 documents
            assert abs(seen["small"] - len(taken) / 2) <= 64
    assert len(bins) <= len({r["sequence_id"] for r in plain}) + -(-1500 // 64) + 4
    assert corpus_pipeline.pack(spark, spark.read.schema(DOC).parquet(str(tmp_path / "mixed")).where("false"), str(tmp_path)).count() == 0


def test_packing(spark, odd_rows):
    path, df = tokenizer_file("word_bpe_49k.json"), frame(spark, odd_rows)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    got = bin_slack.pack(df.withColumn("length", F.lit(1)), path).collect()
    want = Counter()
    for i, t in odd_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p, start in enumerate(range(0, len(ids), 4096)):
            piece = np.array(ids[start : start + 4096], "<u4")
            want[(i, p, start, len(piece), zlib.crc32(piece.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r["length"] for r in got) // 4096)
    assert bin_slack.pack(df.where("false"), path).count() == 0


def test_word_encoder_equals_whole_text():
    enc, rng = bin_slack.WordEncoder(tokenizer_file("word_bpe_49k.json")), random.Random(1)
    alphabet = "aAbB'.,!?;: \n\t1½é É́ßΣİ|%<\x1f\xa0漢"
    for t in ["", "don't it's I'M", "<|endoftext|> x", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(400))]:
        assert next(enc.encode_all([t])) == np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_minimum_slack_finds_the_fullest():
    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
        room = rng.randint(1, 100)
        items = [k for k, n in counts.items() for _ in range(n)]
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        chosen = bin_slack.fullest(counts, room)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[k] for k, n in chosen.items())


def removed(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, odd_rows):
    passage = " ".join(texts(3, 8))
    rows = [r for r in odd_rows if r[0] not in (None, 5)] + [(40 + i, f"é{i} start " + passage[i * 7 : 300 + i * 11] + f" end {i}") for i in range(6)]
    rows += [(60, "ab" * 300), (61, passage + passage), (62, "x" * 99), (63, "x" * 99), (64, "x" * 250)]
    got = suffix_dedup.remove_repeats(frame(spark, rows).withColumn("uid", F.lit(1))).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == removed(rows)
    twice = suffix_dedup.remove_repeats(frame(spark, [(1, passage), (1, passage), (None, passage)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in twice) == [("1", len(passage)), ("1", len(passage)), ("None", 0)]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    # a null id comes first, one id with two texts is two documents; a passage that all hold, in many batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        hot = [(None, passage + " null"), *[(i, f"{i} {passage} {i * 7}") for i in range(40)]]
        got = {str(r["doc_id"]): tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame(spark, hot).repartition(3)).collect()}
        want = removed([(-1 if i is None else i, t) for i, t in hot])
        assert got == {"None" if i < 0 else str(i): x for i, x in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    two = suffix_dedup.remove_repeats(frame(spark, [(1, passage + " one"), (1, passage + " two")])).collect()
    assert sorted(r["n_removed"] > 0 for r in two) == [False, True]


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(100):
        n = rng.randint(5, 90)
        codes = np.array([rng.choice([0, 1, 2, 3, 3, 3]) for _ in range(n)], np.int16)
        wanted = np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
        got = suffix_dedup.sort_suffixes(codes, wanted, 40)
        keys = [tuple(codes[i : i + 40].tolist()) + (511,) * (40 - len(codes[i : i + 40])) for i in got]
        assert sorted(got.tolist()) == wanted.tolist() and keys == sorted(keys)


def test_token_counts(spark, odd_rows):
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    rows = [*odd_rows, (70, "a\n\n\nb  \n c"), (71, "漢字\né\n"), (72, "\n")]
    got = token_counts.section_tokens(frame(spark, rows), path, public_tokenizers.PATTERN).collect()
    enc = token_counts.encoder(path, public_tokenizers.PATTERN).encoding
    totals = Counter()
    for r in got:
        totals[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, t in rows:
        want[i] += len(enc.encode_ordinary(t or ""))
    assert +totals == +want
    starts, ends = np.array([0, 2, 6]), np.array([2, 6, 7])
    assert token_counts.attribute(starts, ends, np.array([3, 6]), 7)[0].tolist() == [1, 1, 1]
    assert token_counts.attribute(starts, ends, np.array([4, 6]), 7)[0].tolist() == [2, 0, 1]  # equal shares: the earlier
    fields = spark.createDataFrame([(1, "title body", [6, 6, None, 99])], "doc_id long, text string, cuts array<long>")
    assert [r["section"] for r in token_counts.section_tokens(fields, path, public_tokenizers.PATTERN, sections="cuts").collect()] == [0, 1]


def test_lattice_sums_all_segmentations():
    pieces = lm_lattice.load_pieces(tokenizer_file("piece_bpe_32k.model"))
    known = {int(k): int(i) for k, i in zip(pieces.keys, pieces.ids, strict=True)}
    for w in (b"the", b"\xc3\xa9a", b"idiot", b"", b"xq"):
        x, total = b" " + w, 0.0
        for cuts in itertools.product([0, 1], repeat=len(x) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(x)]
            parts = [x[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            ids = [known.get(lm_lattice._hash(p)) for p in parts]
            if None not in ids:
                total += math.exp(sum(pieces.logp[i] for i in ids))
        assert abs(lm_lattice.forward([w], pieces, pieces.logp[None])[0, 0] - math.log(total)) < 1e-9


def test_long_words_sum_the_same():
    pieces, rng = lm_lattice.load_pieces(tokenizer_file("piece_bpe_32k.model")), random.Random(8)
    for n in (1, 30, 255):
        w = bytes(rng.choice(b"abcdefgh\xc3\xa9") for _ in range(n))
        assert np.allclose(lm_lattice._forward_long(w, pieces, pieces.logp[None]), lm_lattice.forward([w], pieces, pieces.logp[None])[:, 0])
    long = lm_lattice.forward([b"ab" * 40_000], pieces, pieces.logp[None])[0, 0]
    assert math.isfinite(long) and long < -80_000
    totals = np.zeros((1, len(pieces.logp)))
    lm_lattice.forward([b"ab" * 1000], pieces, pieces.logp[None], totals)
    assert totals.sum() > 100
    assert max(pieces.lengths) > 16  # every piece of the vocabulary, of any length


def test_lattice_scores(spark, odd_rows):
    path, train = tokenizer_file("piece_bpe_32k.model"), id_crc() % 7 != 2
    rows = [*odd_rows, (90, "y" * 70_000)]
    got = lm_lattice.score(frame(spark, rows).withColumn("score", F.lit("x")), train, path).collect()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in lm_lattice.words_of(t))
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in lm_lattice.words_of(t)) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == n and abs(r["base_score"] - base[r["doc_id"]]) < 1e-6 * max(1, abs(base[r["doc_id"]]))
        assert r["held_out"] == held[r["doc_id"]] and math.isfinite(r["score"]) and r["score"] < 0
    assert lm_lattice.score(frame(spark, []), train, path).count() == 0
    untrained = lm_lattice.score(frame(spark, [(1, "some words")]), F.lit(False), path).collect()
    assert untrained[0]["train_tokens"] == 0 and untrained[0]["n_known"] == 0


def test_lattice_scores_are_sums_over_segmentations(spark):
    """score with the given weights alone, against all segmentations and classes by brute force."""
    path = tokenizer_file("piece_bpe_32k.model")
    rows = [(1, "the cat sat", "en"), (2, "The mat", "en"), (3, "le chat", "fr"), (4, "the chat", None), (5, "cat xq", "en"), (6, "", "fr"), (7, None, "de")]
    df = spark.createDataFrame([(i, t, c, "s", 0) for i, t, c in rows], DOC)
    train = F.col("doc_id") <= 4
    got = {r["doc_id"]: r["score"] for r in lm_lattice.score(df, train, path, max_classes=1, steps=0).collect()}
    pieces = lm_lattice.load_pieces(path)
    known = {int(k): int(i) for k, i in zip(pieces.keys, pieces.ids, strict=True)}

    def lattice(w):
        x, total = b" " + w, 0.0
        for cuts in itertools.product([0, 1], repeat=len(x) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(x)]
            ids = [known.get(lm_lattice._hash(x[a:b])) for a, b in zip([0, *ends], ends, strict=False)]
            total += 0.0 if None in ids else math.exp(sum(pieces.logp[i] for i in ids))
        return total

    words = {i: lm_lattice.words_of(t) for i, t, _ in rows}
    by_class = [Counter(w for i, _, c in rows if i <= 4 and (c == "en") == (z == 0) for w in words[i]) for z in (0, 1)]
    every = by_class[0] + by_class[1]
    once, twice = (sum(1 for c in every.values() if c == k) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice)))
    n, v = sum(every.values()), len(every)
    size = [sum(c.values()) for c in by_class]

    def p(w, z):
        whole = max(every[w] - d, 0) / n + d * v / n * lattice(w)
        back = (1 - lm_lattice.ELSEWHERE) * lattice(w) + lm_lattice.ELSEWHERE * whole
        return max(by_class[z][w] - d, 0) / size[z] + d * len(by_class[z]) / size[z] * back

    for i, ws in words.items():
        want = sum((size[z] + 1) / (n + 2) * math.prod(p(w, z) for w in ws) for z in (0, 1))
        assert abs(got[i] - math.log10(want)) < 1e-4 * abs(got[i])


def labelled(spark, n, bad):
    rng, rows, labels = random.Random(6), [], []
    for i, t in enumerate(texts(n, 7)):
        flag = i % 4 == 0
        rows.append((i, bad(t, rng) if flag else t))
        labels.append((i, int(not flag), int(flag)))
    labels += [(0, 0, 1), (99999, 1, 1), (3, None, None), (None, 1, 0)]
    return frame(spark, [*rows, (5000, None), (5001, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out_accuracy(rows, wrong):
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 5000]
    return np.mean([r["predicted"] == wrong(r["doc_id"]) for r in held])


def test_quality(spark):
    docs, labels = labelled(spark, 240, lambda t, rng: " ".join(w.upper() + "!!" for w in t.split()))
    got = quality_nbsvm.classify(docs.withColumn("label", F.lit("clash")).withColumn("score", F.lit(1)), labels).collect()
    assert len(got) == 242 and held_out_accuracy(got, lambda i: int(i % 4 != 0)) > 0.95
    flat = quality_nbsvm.classify(docs, labels.where("false")).collect()
    assert {round(r["score"], 6) for r in flat} == {0.5}
    short = quality_nbsvm.fit(docs, labels, max_slots=2000)  # fewer rows teach, whatever their number
    assert 0 <= short.score(quality_nbsvm.features("kara loven")) <= 1
    model = quality_nbsvm.fit(docs, labels)
    assert model.score(quality_nbsvm.features("KARA!! LOVEN!! MIPIK!! NEDOL!!")) < 0.5 < model.score(quality_nbsvm.features("kara loven mipik nedol"))
    odd = frame(spark, [(1, "kara " * 30000), (1, "kara " * 30000), (2, None), (None, "x")])
    assert len(quality_nbsvm.score(odd, model).collect()) == 4 and quality_nbsvm.classify(docs.where("false"), labels).count() == 0
    assert quality_nbsvm.keep_good(docs, model).columns == docs.columns


def test_quality_tells_words_apart(spark):
    """Texts of one shape: only their words tell the classes."""
    docs, labels = labelled(spark, 240, lambda t, rng: " ".join(w[::-1] if i % 3 == 0 else w for i, w in enumerate(t.split())))
    got = quality_nbsvm.classify(docs, labels).collect()
    assert held_out_accuracy(got, lambda i: int(i % 4 != 0)) > 0.95
    a, b = quality_nbsvm.features("the good dog ran home."), quality_nbsvm.features("xqz vvvv bbb jjj kkkkk.")
    assert len(set(a) & set(b)) < len(a) / 2
    long = "a1" * 40
    assert set(quality_nbsvm.features(long + "b")) != set(quality_nbsvm.features(long + "!"))


def test_toxicity(spark):
    def bad(t, rng):
        w = t.split()
        w.insert(rng.randrange(len(w)), rng.choice(["wretchful", "blaggard"]))
        return " ".join(w)

    docs, labels = labelled(spark, 400, bad)
    got = toxicity_ssk.classify(docs, labels).collect()
    assert len(got) == 402 and held_out_accuracy(got, lambda i: int(i % 4 == 0)) > 0.95
    model = toxicity_ssk.fit(docs, labels)

    def score(*units):
        return [model.curve(toxicity_ssk.strongest(model, [f"kara {u} loven"])[0][0][0]) for u in units]

    inserted = [w[:i] + c + w[i:] for w in ("wretchful", "blaggard") for i in range(1, len(w)) for c in "aqz07"]
    hits = np.array(score(*inserted)) >= 0.7
    assert hits.mean() > 0.85 and min(score("w r e t c h f u l", "b.l.a.g.g.a.r.d", "WRETCHFUL!!")) >= 0.7
    alike = dict(zip(("wrench", "fulfil", "fretful", "ragged", "kara", "x" * 9000), score("wrench", "fulfil", "fretful", "ragged", "kara", "x" * 9000), strict=True))
    assert max(alike.values()) < 0.7, alike
    flat = toxicity_ssk.classify(docs, labels.where("false")).collect()
    assert {round(r["score"], 6) for r in flat} == {0.5}
    odd = frame(spark, [(1, "kara " * 30000), (1, "kara " * 30000), (2, None), (None, "blaggard")]).withColumn("toxic", F.lit(1))
    assert len(toxicity_ssk.score(odd, model).collect()) == 4 and toxicity_ssk.classify(odd.where("false"), labels).count() == 0


def test_kernel_is_exact():
    def brute(s, t, d):
        return sum(d ** (a[2] - a[0] + b[2] - b[0] + 2) for a in itertools.combinations(range(len(s)), 3) for b in itertools.combinations(range(len(t)), 3) if all(s[i] == t[j] for i, j in zip(a, b, strict=True)))

    for s, t in (("idiot", "idixot"), ("moron", "oronmo"), ("abcabc", "aabbcc"), ("añb", "añb")):
        assert abs(toxicity_ssk.kernel([s], [t, "zzz"], 0.5)[0, 0] - brute(s, t, 0.5)) < 1e-12
        assert abs(toxicity_ssk.self_kernel([s], 0.5)[0] - brute(s, s, 0.5)) < 1e-6


def test_solvers():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(1, 0.5, (60, 4)), rng.normal(-1, 0.5, (60, 4))]
    y = np.r_[np.ones(60), np.zeros(60)]
    w, b = linear_svm.fit_dual([(np.arange(4), r) for r in x], y, 4, np.ones(120))
    u, c = linear_svm.fit_primal(x, y, np.ones(120))
    assert (((x @ w + b) > 0) == y).mean() > 0.97 and (((x @ u + c) > 0) == y).mean() > 0.97
    slope, shift = linear_svm.fit_sigmoid(x @ w + b, y)
    assert slope > 0 and math.isfinite(shift)


def test_pipeline(spark, tmp_path, odd_rows):
    """Against brute force: what a good model keeps, then the largest id of equal texts, then one of each near group."""
    import corpus_pipeline

    bad = [(1000 + i, t.upper().replace(" ", "!! ") + "!!") for i, t in enumerate(texts(60, 21))]
    good = [(2000 + i, t) for i, t in enumerate(texts(120, 22))]
    rows = [r for r in odd_rows if r[0] not in (None, 5, 21)] + bad + good
    labels = spark.createDataFrame([(i, 0, 0) for i, _ in bad] + [(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    extra = frame(spark, rows).withColumn("kept", F.lit("clash")).withColumn("_row", F.lit(7))
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality_nbsvm.fit(docs, labels, where=id_crc() % 3 != 1)
    rejected = {r["doc_id"] for r in quality_nbsvm.score(docs, model).where("predicted = 0").collect()}
    assert {i for i, _ in bad} <= rejected and not {i for i, _ in good} & rejected  # the stage drops rows, clean ones stay
    last = {}
    for i, t in rows:
        if i not in rejected:
            last[sha_low(t)] = max(last.get(sha_low(t), (i, t)), (i, t), key=lambda x: x[0])
    want = set(components_of(list(last.values())).values())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
