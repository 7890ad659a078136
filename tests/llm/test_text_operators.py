import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessergraph.llm import bpe, licenses, packing, quality, sharding, simhash, substrings
from tests.llm.helpers import awkward_docs, none_of, prose, words

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def library(path):
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(path).ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aé'strevlmd '\n\t 　\x1c1²中\U0001f600.,!")), max_size=30), max_size=6))
def test_encoding_equals_the_library(texts):
    known = library(MULTI)
    for text, (ids, offsets, counts) in zip(texts, bpe.encode(texts, MULTI)):
        assert ids == known.encode_ordinary(text)
        assert bpe.decode(ids, MULTI) == text.encode()
        assert sum(counts) == len(ids) and list(offsets) == sorted(set(offsets))


def test_both_merges_equal_the_library():
    ranks, draw, known = bpe.vocabulary(MULTI).ranks, random.Random(5), library(MULTI)
    for n in (1, 2, 7, 40, 300, 2000):
        piece = "".join(draw.choice("aeiotns") for _ in range(n)).encode()
        want = known._core_bpe.encode_single_piece(piece)
        assert bpe.merge(piece, ranks) == want and bpe.merge_long(piece, ranks) == want


def test_round_trip_table(docs, rows):
    known, got = library(MULTI), Counter(map(tuple, bpe.round_trip(docs, MULTI).collect()))
    want = Counter()
    for r in rows:
        ids = known.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(none_of(docs), MULTI).count() == 0
    held = bpe.encode_documents(docs, MULTI).where("doc_id = 0").first()
    assert list(held.ids) == known.encode_ordinary(rows[0].text) and sum(held.counts) == len(held.ids)


def check_packing(got, texts):
    json = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids, at = np.array(json.encode(text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence)


def test_packing(docs, rows):
    unique = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    got = packing.pack_documents(unique, *packing.tokenizer_files()).collect()
    n = check_packing(got, {r.doc_id: r.text for r in rows if r.doc_id is not None})
    assert n == -(-sum(r.length for r in got) // 1024)
    assert packing.pack_documents(none_of(docs), *packing.tokenizer_files()).count() == 0
    assert packing.pack_documents(docs, *packing.tokenizer_files()).count() > len(got)  # repeated rows are packed again
    held = packing.sequences(unique, *packing.tokenizer_files()).collect()
    assert len(held) == n and all(len(r.ids) <= 1024 for r in held)


def test_ids_equal_the_tokenizer_file():
    path, ranks = packing.tokenizer_files()
    json, encode = Tokenizer.from_file(path), packing._encoder(path, ranks)
    for text in ("", "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> \n", "  <|endoftext|><|endoftext|>x  ", "<|endoftext", "don't  <|endoftext|>'s", "<|<|endoftext|>|>"):
        assert encode(text) == json.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    draw = np.random.default_rng(2)
    for size in (1, 50, 5000):
        counts = np.bincount(np.minimum(draw.geometric(0.004, size), 1024), minlength=1025)
        used = Counter()
        for lengths, times in packing.plan(counts):
            assert sum(lengths) <= 1024 and times > 0
            for n in lengths:
                used[n] += times
        assert used == Counter({n: int(c) for n, c in enumerate(counts) if c})


def brute_substrings(texts):
    seen, out = set(), {}
    for doc in sorted(texts):
        w = words(texts[doc])
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(docs, rows):
    want = brute_substrings({-1 if r.doc_id is None else r.doc_id: r.text for r in rows})
    got = substrings.digests(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[-1 if r.doc_id is None else r.doc_id]
    assert any(r.n_removed for r in got)
    assert substrings.digests(none_of(docs)).count() == 0


def test_substrings_of_random_overlaps(spark):
    draw = random.Random(8)
    pool = [prose(draw, 30) for _ in range(6)]
    texts = {i: " ".join(" ".join(draw.choice(pool).split()[draw.randint(0, 8) :]) for _ in range(draw.randint(1, 5))) for i in range(60)}
    got = substrings.digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = brute_substrings(texts)
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got) and len(got) == 60


def test_stream_of_anchors_across_batches():
    import pandas as pd

    draw = random.Random(1)
    rows = sorted({(draw.randint(0, 12), draw.randint(0, 3), draw.randint(0, 5), draw.randint(0, 4)) for _ in range(120)})
    rows += [rows[7]]
    rows.sort()
    frame = pd.DataFrame(rows, columns=list("hckp")).astype("int64").assign(done=False)
    want = set(map(tuple, pd.concat(substrings.repeated_anchors(iter([frame]))).to_numpy().tolist()))
    for size in (1, 2, 5, 17):
        parts = [frame.iloc[i : i + size] for i in range(0, len(frame), size)]
        assert set(map(tuple, pd.concat(substrings.repeated_anchors(iter(parts))).to_numpy().tolist())) == want
    expected, first, heads = set(), {}, defaultdict(dict)
    for h, c, k, p in rows:
        if (h, c) not in first:
            first[h, c] = (k, p)
            heads[h][c] = (k, p)
        elif first[h, c] != (k, p):
            expected.add((k, p, 1))
    expected |= {(*at, 0) for own in heads.values() if len(own) > 1 for at in own.values()}
    assert {(k, p, int(w)) for k, p, w in want} == expected
    held = substrings.combined(frame.drop(columns="done").sample(frac=1, random_state=1))
    settled = {tuple(x) for x in held.loc[held["done"], ["k", "p"]].to_numpy().tolist()}
    assert settled == {(k, p) for k, p, w in expected if w}
    held = held[~held["done"]].sort_values(list("hckp"))
    again = pd.concat(substrings.repeated_anchors(iter([held]))).to_numpy().tolist()
    assert {(k, p) for k, p, w in again if not w} == {(k, p) for k, p, w in expected if not w}


def test_cut_repeats_keeps_columns(docs):
    out = substrings.cut_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect() if r.doc_id != 2 and r.doc_id is not None)


def brute_fingerprint(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(links, nodes):
    head = {n: n for n in nodes}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(docs, rows):
    prints = {r.doc_id: brute_fingerprint(r.text, 4) for r in rows if r.doc_id is not None}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = brute_components(near, prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.near_duplicates(none_of(docs)).count() == 0


@pytest.mark.parametrize("spread", [2, 3, 9])
def test_links_of_random_fingerprints(spark, spread):
    draw = random.Random(spread)
    centres = [draw.getrandbits(64) for _ in range(8)]
    prints = {}
    for i in range(900):
        x = draw.choice(centres)
        for _ in range(draw.randint(0, spread)):
            x ^= 1 << draw.randrange(64)
        prints[i] = x
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in prints.items()]
    got = {r.doc_id: r.component for r in simhash.near_components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    near = [(a, b) for a in prints for b in range(a + 1, 900) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert got == brute_components(near, prints)


def test_plans_cover_the_radius():
    sample = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 500, np.int64)
    for n in (1, 1000, 10**6, 10**9):
        parts = simhash.plan(sample, n, 4)
        assert sum(t + 1 for _, t in parts) > 4 and len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)


def test_near_copies_are_dropped(spark):
    draw = random.Random(12)
    base = [prose(draw, 300) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:10]):
        w = t.split()
        w[150] = "changed"
        rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, t))
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(3, base[3], "x")], "doc_id long, text string, fp string")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    assert simhash.drop_near_copies(none_of(docs)).count() == 0


def brute_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def test_quality_rules(docs, rows):
    got = quality.judge(docs).collect()
    want = {r.doc_id: brute_quality(r.text) for r in rows}
    assert len(got) == len(rows)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id] for r in got)
    assert all(not r.kept for r in got if r.base_failed)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.judge(none_of(docs)).count() == 0 and quality.keep_good(none_of(docs)).count() == 0


def test_bad_hosts_are_rejected(spark):
    good, bad = prose(random.Random(1), 50), "too short"
    rows = [(i, good, "fine") for i in range(300)] + [(1000 + i, bad if i < 290 else good, "spam") for i in range(300)] + [(5000, good, None)]
    rows += [(6000 + i, good if i % 20 else bad, f"h{i % 7}") for i in range(350)]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(1000 <= i < 5000 for i in kept) and 5000 in kept and set(range(300)) <= kept


def test_sharding(docs, rows):
    got = sharding.assign_shards(docs, 8, ranges=4, sample=10).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in held.values())
    total, most = sum(size(r.text) for r in rows), max(size(r.text) for r in rows)
    assert all(sum(r["size"] for r in held[k]) <= total / 8 + most for k in range(8))
    assert sharding.assign_shards(none_of(docs)).count() == 0


def test_shards_of_a_hot_group_are_even(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(6000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), ranges=64, sample=2000)
    sums = [r[0] for r in got.groupBy("shard").agg({"size": "sum"}).select("sum(size)").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 40


def test_license_scan(spark, docs):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-header"]
    cases = {
        1: f"{prose(random.Random(1), 50)}\n{mit}\n{prose(random.Random(2), 50)}",
        2: apache.replace("governing", "that govern").replace("express or implied", "express, implied"),
        3: "x Released under the MIT License. y Licensed under CC BY-NC 4.0. z",
        4: "A license to print money, permission is hereby refused.",
        5: None,
        6: " ".join(["Released under the MIT License."] * 3),
    }
    got = licenses.scan_documents(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()
    names = defaultdict(list)
    for r in got:
        names[r.doc_id].append(r.license)
    assert names == {1: ["MIT"], 2: ["Apache-header"], 3: ["MIT-notice", "CC-BY-NC-notice"], 4: [None], 5: [None], 6: ["MIT-notice"] * 3}
    assert [(r.start_word, r.end_word) for r in got if r.doc_id == 1] == [(50, 50 + len(licenses.words_of(mit)))]
    assert licenses.scan_documents(docs).count() == docs.count()
    assert licenses.scan_documents(none_of(docs)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefghij"), max_size=25), st.lists(st.sampled_from("abcdefghij"), max_size=25))
def test_alignment_is_increasing_and_equal(left, right):
    pairs = licenses.align(left, right)
    assert all(left[i] == right[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    if left == right:
        assert len(pairs) == len(left)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(9)))
def test_longest_increasing(order):
    pairs = list(enumerate(order))
    best = licenses.longest_increasing(pairs)
    longest = [1] * 9
    for i in range(9):
        longest[i] += max((longest[j] for j in range(i) if order[j] < order[i]), default=0)
    assert len(best) == max(longest) and all(a[1] < b[1] for a, b in zip(best, best[1:]))


def test_written_shards(spark, docs, rows, tmp_path):
    named = docs.withColumn("shard", F.lit(7)).withColumn("slot", F.lit(1))
    sharding.write_shards(named, str(tmp_path / "out"), task_rows=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select(*named.columns).collect())) == Counter((*r, 7, 1) for r in rows)
    where = Counter(map(tuple, back.select("doc_id", F.col("shard_").cast("int")).collect()))
    assert where == Counter((r.doc_id, r.shard) for r in sharding.assign_shards(docs).collect())
    sharding.write_shards(none_of(docs), str(tmp_path / "none"))
