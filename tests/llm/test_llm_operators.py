"""The ten operators on small tables: nulls, empty and very long texts, ties, repeated rows,
empty tables and clashing columns, against brute force, round trips or held-out accuracy."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import public_tokenizers  # noqa: E402

from liveset.llm import arrowfiles, chat, decontaminate, jaccard, langid, packing, quality, sharding, substrings, topk  # noqa: E402
from liveset.llm.common import Hasher, Words, components  # noqa: E402
from liveset.llm.tokens import Encoder  # noqa: E402

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


def prose(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n)]


def documents(spark, texts, **extra):
    """Texts with ids from 0, and columns whose names operators use themselves."""
    names = ["class_id", "n_words", "shard", "ids", "places", "key", "lang_pred", "_note"]
    rows = [(i, t, *[f"x{i}"] * len(names)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + "".join(f", `{n}` string" for n in names)).repartition(3, "doc_id").sortWithinPartitions("doc_id")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Frames written as files, as operators that read their input twice ask for."""
    folder, count = tmp_path_factory.mktemp("docs"), iter(range(10_000))

    def store(df):
        path = str(folder / str(next(count)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    return store


def odd_texts():
    a, b = prose(1, 300), prose(2, 80)
    near = a[:150] + ["changed"] + a[151:]
    return [
        " ".join(a), " ".join(a), " ".join(near), " ".join(b), None, "", " \n\t ", "one", "one", "two words", " ".join(a[:40]),
        " ".join(prose(3, 20) + b[10:50] + prose(4, 20)), "\n".join(prose(5, 20_000)), " ".join(["again"] * 100), "ünïcode ça " * 30, " ".join(b) + " ",
    ]


# --- words, components ---------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té x", max_size=40), min_size=1, max_size=6), st.integers(1, 4))
def test_words_and_windows_equal_regular_expressions(texts, size):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = Words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]), Hasher())
    split = [re.findall(rb"[^\x20\x09-\x0D]+", r) for r in raw]
    assert np.diff(words.first).tolist() == [len(s) for s in split]
    assert [data[s:e].tobytes() for s, e in zip(words.start, words.end)] == [w for s in split for w in s]
    at, hashes = words.windows(size)
    runs = [tuple(s[k:k + size]) for s in split for k in range(len(s) - size + 1)]
    assert len(at) == len(runs)
    assert len(set(zip(runs, hashes.tolist()))) == len(set(runs)) == len(set(hashes.tolist()))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 language ------------------------------------------------------------------------------

def test_language_accuracy_and_odd_texts(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(folder).select("doc_id", "text", "lang")
    network = langid.train(docs.filter("doc_id % 4 <> 2"), rows=800)
    got = langid.identify(docs.filter("doc_id % 4 = 2"), network)
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97
    odd = documents(spark, [None, "", "123 !!", "a", "the of and " * 9000])
    rows = {r["doc_id"]: r for r in langid.identify(odd, network).collect()}
    assert [rows[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and rows[0]["lang_score"] == 0.0
    assert rows[3]["lang_pred"] in network.languages and rows[4]["lang_pred"] == "en"
    assert rows[4]["_note"] == "x4" and all(0 <= r["lang_score"] <= 1 for r in rows.values())


def test_language_without_labels_or_rows(spark):
    none = spark.createDataFrame([("text", None), (None, "en"), ("12", "en")], "text string, lang string")
    assert langid.train(none) is None
    assert langid.identify(none, None).select("lang_pred").distinct().collect()[0][0] == "und"
    one = langid.train(spark.createDataFrame([("abc", "xx")] * 3, "text string, lang string"))
    assert langid.identify(none.limit(0), one).count() == 0


def test_language_of_many_copies_keeps_its_share(spark):
    copies = spark.range(200_000).select(F.lit("one text again").alias("text"), F.lit("xx").alias("lang"))
    others = spark.range(300).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("xx").alias("lang"))
    plain = spark.range(300).select(F.concat(F.lit("other "), F.col("id").cast("string")).alias("text"), F.lit("yy").alias("lang"))
    single = spark.createDataFrame([("alone", "zz")], "text string, lang string")
    got = [lang for lang, _ in langid.sample(copies.union(others).union(plain).union(single), rows=300)]
    assert {x: got.count(x) for x in got} == {"xx": 100, "yy": 100, "zz": 1}
    many = spark.range(4000).select((F.col("id") % 400).cast("string").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert len({lang for lang, _ in langid.sample(many, rows=20)}) == 400


# --- 2 and 10 tokens, files, packing ---------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZé ~\ń  \x1c'sſİΣ<|endoftext|>9", max_size=60), max_size=5))
def test_encoder_equals_the_library(texts):
    quick, plain = _encoder(False), _encoder(True)
    assert not quick.whole
    for a, b in zip(quick.encode_many(texts), plain.encode_many(texts)):
        assert a.tolist() == b.tolist()


_kept: dict = {}


def _encoder(whole):
    if whole not in _kept:
        _kept[whole] = Encoder(WORD_BPE, whole=whole, kept=50)
    return _kept[whole]


def test_long_text_and_other_tokenizers():
    text = " ".join(prose(9, 400_000))
    assert _encoder(False).encode(text).tolist() == _encoder(True).encode(text).tolist()
    assert Encoder(BYTE_BPE).whole


def expected_ids(text):
    return _encoder(True).encode(text).tolist() + [2]


def test_token_files_round_trip(spark, tmp_path):
    texts = odd_texts()
    docs = documents(spark, texts).union(documents(spark, texts[:1]))  # a repeated row
    manifest = arrowfiles.write_tokens(docs, WORD_BPE, str(tmp_path / "t"), length=64, batch=4, n_parts=3)
    got = arrowfiles.read_documents(spark, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([*range(len(texts)), 0])
    at = 0
    for r in got:
        ids = expected_ids(texts[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and (r["start"], r["n_tokens"], r["whole"]) == (at, len(ids), True)
        at += len(ids)
    first = manifest.orderBy("part").first()
    shard = arrowfiles.ShardReader(first["path"])
    ids, mask = shard.sequence(0)
    assert ids.shape == mask.shape == (64,) and ids.tolist() == np.concatenate([expected_ids(texts[0])] * 2)[:64].tolist() and mask.all()
    last_ids, last_mask = shard.sequence(first["n_sequences"] - 1)
    assert last_mask.sum() == first["n_tokens"] - 64 * (first["n_sequences"] - 1) and not last_ids[~last_mask].any()


def test_token_files_of_nothing(spark, tmp_path):
    manifest = arrowfiles.write_tokens(spark.createDataFrame([], DOCS), WORD_BPE, str(tmp_path / "t"))
    assert manifest.count() == 0 and arrowfiles.read_documents(spark, manifest).count() == 0


def check_pieces(rows, window):
    by_doc, by_sequence = {}, {}
    for doc, start, ids, total, sequence, offset in rows:
        by_doc.setdefault(doc, []).append((start, list(ids), total))
        by_sequence.setdefault(sequence, []).append((offset, len(ids)))
    for pieces in by_sequence.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at and size > 0
            at += size
        assert at == window or (at < window and at & (at - 1) == 0)
    whole = {}
    for doc, pieces in by_doc.items():
        ids = []
        for start, part, total in sorted(pieces):
            assert start == len(ids)
            ids += part
            assert total == pieces[0][2]
        assert len(ids) == pieces[0][2]
        whole[doc] = ids
    return whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(2, 12))
def test_packer_places_every_id_once_without_padding(sizes, most_open):
    packer = packing.Packer(window=16, most_open=most_open)
    docs = {i: list(range(100 * i, 100 * i + n)) for i, n in enumerate(sizes)}
    for i, ids in docs.items():
        packer.add(i, np.array(ids, np.uint32))
    packer.pour(last=True)
    assert check_pieces(packer.out, 16) == docs


def test_packer_chooses_the_least_sum_of_squares():
    packer = packing.Packer(window=10)
    for i, n in enumerate([6, 6, 4]):
        packer.add(i, np.zeros(n, np.uint32))
    # Two windows at 6; closing one leaves 1, a third fill would leave 4 + 1.
    assert packer.levels[6] == 1 and packer.n_open == 1 and packer.next == 1


def test_packing_of_odd_texts(spark):
    texts = odd_texts()
    rows = packing.pack(documents(spark, texts), WORD_BPE, window=256).collect()
    got = check_pieces([(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in rows], 256)
    assert {d: [int(x) for x in ids] for d, ids in got.items()} == {i: expected_ids(t) for i, t in enumerate(texts)}
    assert packing.pack(spark.createDataFrame([], DOCS), WORD_BPE).count() == 0
    null = packing.pack(spark.createDataFrame([(None, None)], DOCS), WORD_BPE).collect()
    assert len(null) == 1 and null[0]["doc_id"] is None and null[0]["length"] == 1


# --- 3 sharding ------------------------------------------------------------------------------

def test_table_is_even_and_stable():
    shards = tuple(f"s{i}" for i in range(10))
    full, fewer = sharding.fill(shards, 1009), sharding.fill(shards[:-1], 1009)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    moved = sum(a != b for a, b in zip(full, fewer) if a != 9)
    assert moved < 0.2 * 1009
    for bad in ((shards, 1000), ((), 7), (("a", "a"), 7), (shards, 7)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_placement(spark):
    docs = documents(spark, odd_texts())
    owner = sharding.fill(("a", "b", "c"), 101)
    got = sharding.place(docs, F.col("text"), ("a", "b", "c"), 101)
    assert got.count() == docs.count() and "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    for r in got.collect():
        slot = int(hashlib.md5((r["text"] or "").encode()).hexdigest()[:15], 16) % 101
        assert r["slot"] == slot and r["shard"] == "abc"[owner[slot]]
    assert sharding.place(docs.limit(0), F.col("doc_id")).count() == 0


def test_written_shards(spark, tmp_path):
    placed = sharding.place(documents(spark, odd_texts()).select("doc_id"), F.lit("hot"), ("a", "b"), 11)
    sharding.write_shards(placed, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 1


# --- 4 near duplicates -----------------------------------------------------------------------

def test_pruning_bounds_keep_the_threshold():
    least = jaccard.least_matches(0.8)
    assert all(0 < m < 0.8 * n for m, n in zip(least, jaccard.STEPS)) and least == sorted(least)


@pytest.mark.parametrize("words", [3, 30, 300, 1000, 20_000])
def test_unlike_texts_of_any_length_are_pruned(words):
    texts = [" ".join(prose(100 + k, words)) for k in range(12)]
    texts.append(texts[0])
    batch = pa.RecordBatch.from_arrays([pa.array(range(13)), pa.array([b"k"] * 13), pa.array(texts)], names=["_rid", "_key", "text"])
    sig = np.concatenate([jaccard.matrix(b.column("sig"), jaccard.HASHES) for b in jaccard._features([batch])])
    left, right = np.triu_indices(13, 1)
    stay = jaccard.likely(sig, left, right, jaccard.least_matches(0.8))
    assert list(zip(left[stay].tolist(), right[stay].tolist())) == [(0, 12)]


def test_near_duplicates_equal_brute_force(spark, stored):
    texts = odd_texts()
    base = prose(20, 200)
    rng = np.random.default_rng(3)
    for k in range(60):  # a family with similarities around the threshold
        t = list(base)
        for at in rng.integers(0, 200, k % 12):
            t[at] = f"w{k}"
        texts.append(" ".join(t))
    docs = stored(documents(spark, texts))
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"], r["_note"]) for r in jaccard.near_duplicates(docs).collect()}
    for i, (root, links) in enumerate(jaccard.brute_force(texts)):
        word = bool(re.search(r"[^\s]", texts[i] or ""))
        assert got[i] == (root, links, texts.count(texts[i]) if word else 1, f"x{i}"), texts[i]
    kept = sorted(r["doc_id"] for r in jaccard.one_of_each(docs).select("doc_id").collect())
    assert kept == sorted({root for root, _ in jaccard.brute_force(texts)})


def test_large_groups_are_cut_into_chunks(spark, stored, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    base = prose(30, 120)
    texts = [" ".join(base[:k] + [f"v{k}"] + base[k + 1:]) for k in range(110)] + ["other text that is not alike at all"]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(stored(documents(spark, texts))).collect()}
    assert got == dict(enumerate(jaccard.brute_force(texts)))


def test_near_duplicates_of_nothing_and_of_null_ids(spark, stored):
    assert jaccard.near_duplicates(stored(spark.createDataFrame([], DOCS))).count() == 0
    t = " ".join(prose(1, 30))
    got = jaccard.near_duplicates(stored(spark.createDataFrame([(None, t), (None, t), (5, t), (None, "x y")], DOCS))).collect()
    assert sorted((str(r["class_id"]), r["n_copies"]) for r in got) == [("5", 3)] * 3 + [("None", 1)]


# --- 5 quality -------------------------------------------------------------------------------

def test_quality_separates_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    measures = quality.measured(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).cache()
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(measures.filter("doc_id % 3 <> 1").join(labels, "doc_id").select("stats", "label"))
    held = quality.scored(measures.filter("doc_id % 3 = 1"), model).join(labels, "doc_id").collect()
    good, bad = [r["quality_score"] for r in held if r["label"]], [r["quality_score"] for r in held if not r["label"]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([(r["quality_score"] >= 0.5) == (r["label"] == 1) for r in held]) > 0.95
    assert all(np.diff(model.levels) > 0) and 0 <= min(good + bad) <= max(good + bad) <= 1


def test_quality_of_odd_texts(spark):
    measures = quality.measured(documents(spark, odd_texts()))
    rows = {r["doc_id"]: r["stats"] for r in measures.collect()}
    assert all(np.isfinite(s).all() and len(s) == len(quality.STATISTICS) for s in rows.values())
    assert rows[0] == rows[1] and not any(rows[4]) and rows[13][quality.STATISTICS.index("top_word")] == 1.0
    assert quality.fit(spark.createDataFrame([], "stats array<double>, label int")) is None
    assert quality.scored(measures, None).select("quality_score").distinct().collect()[0][0] == 0.5
    one = quality.fit(measures.select("stats", F.lit(1).alias("label")))
    assert min(r["quality_score"] for r in quality.scored(measures, one).collect()) > 0.9


# --- 6 decontamination -----------------------------------------------------------------------

def test_leaks_equal_brute_force(spark, stored):
    items = [" ".join(prose(50 + k, 12 + 3 * k)) for k in range(6)] + ["short item", None, "", "one"]
    filler = lambda s, n: prose(s, n)
    texts = odd_texts() + [
        " ".join(filler(60, 5_000) + items[2].split() + filler(61, 3_000)), items[0], " ".join(items[1].split()[:-2]), " ".join(items[5].split()[:9]),
        " ".join(filler(62, 30)) + "\n" + items[3].replace(" ", "\n") + " end", "a short item here", items[4] + " " + items[0], items[4] + " " + items[0]]

    def grams(words, n):
        return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}

    want = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            w = (item or "").split()
            if w:
                need = grams(w, min(5, len(w)))
                have = len(need & grams((t or "").split(), min(5, len(w))))
                if have >= 0.8 * len(need) - 1e-9:
                    want.add((i, j, have, len(need)))
    bench = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    docs = stored(documents(spark, texts))
    got = [tuple(r) for r in decontaminate.leaks(docs, bench).collect()]
    assert sorted(got) == sorted(want)
    clean = decontaminate.without_leaks(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {w[0] for w in want} and clean.columns == docs.columns
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(stored(docs.limit(0)), bench).count() == 0


def test_extra_bits_bound_the_miss():
    for least in (1, 5, 12, 40):
        bits, needed = decontaminate.extra_bits(least), max(1, int(np.ceil(0.8 * least - 1e-9)))
        assert (2.0 ** -bits / 2) ** needed <= decontaminate.MISS


# --- 7 chat ----------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<|role>textn d", max_size=40) | st.sampled_from(["<|end|>", "<\\|end|>", "<\\\\|role|>x<|text|>", "<|endoftext|>"]))
def test_escape_is_reversible_and_hides_markers(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not re.search(r"<\|(role|text|end|endoftext)\|>", hidden)


def test_chats_round_trip(spark):
    turns = [
        (1, 0, "user", "hi <|end|> there"), (1, 1, "assistant", " leading <|role|>assistant<|text|> \\ tail "), (1, 2, "assistant", None),
        (1, 3, None, "ünï 😀"), (1, 4, "assistant", "😀😀\n"), (2, 0, "assistant", ""), (None, None, "assistant", "no id"),
        (3, 5, "assistant", "tie b"), (3, 5, "assistant", "tie a"), (3, 5, "assistant", "tie a"), (4, 0, "assistant", "<\\|end|>" * 3),
    ] + [(9, k, "assistant" if k % 2 else "user", f"turn {k} " * 3) for k in range(2500)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, mask string")
    segments = chat.format_chats(df, BYTE_BPE).cache()
    got = {r["conv_id"]: r for r in chat.digests(segments, BYTE_BPE).collect()}
    key = lambda t: tuple((x is not None, x) for x in t[1:])
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=key)
        said = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(mine), len(said))
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["formatted_chars"] == len(chat.render([(t[2] or "", t[3] or "") for t in mine])[0])
    # Segments are cut between turns, where the whole text's ids are cut too.
    tokenizer = chat.tokenizer_of(BYTE_BPE)
    parts = sorted((r for r in segments.collect() if r["conv_id"] == 9), key=lambda r: r["segment"])
    assert len(parts) > 2
    assert [i for r in parts for i in r["ids"]] == tokenizer.encode("".join(r["text"] for r in parts), add_special_tokens=False).ids
    assert chat.format_chats(df.limit(0), BYTE_BPE).count() == 0


# --- 8 top k ---------------------------------------------------------------------------------

def brute_top(rows, k):
    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in dict.fromkeys((i, tuple(v)) for i, v in fine if i is not None and i % 100 == 0):
        scores = sorted(((sum(x * y for x, y in zip(a, v)), i) for i, v in fine if i != q), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(q, r, i, max(-topk.LONG, min(topk.LONG, s))) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_last_phase_asks_slices_only_for_rows_in_reach(monkeypatch):
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(4000, 16)) * 1024) / 1024
    scaled = v * 1024
    total = scaled @ scaled[0]
    total[0] = -np.inf
    parts = [scaled[1:, :8] @ scaled[0, :8], scaled[1:, 8:] @ scaled[0, 8:]]
    bound = int(np.sort(total)[-5])
    share = (bound - sum(p.min() for p in parts)) / 2
    vectors = pa.table({"vec_id": pa.array(range(4000)), "v": pa.array(v.tolist())})
    query = pa.table({"query_id": [0], "qkey": [7], "qv": [v[0].tolist()], "bound": [bound], "wide": [False],
                      "cutoffs": [[p.min() + share for p in parts]], "highs": [[float(p.max()) for p in parts]]})
    asked, local = [], topk.Block.local

    def counted(self, i, s, rows=slice(None)):
        out = local(self, i, s, rows)
        asked.append(len(out))
        return out

    monkeypatch.setattr(topk.Block, "local", counted)
    got = topk._entries(5)(query, vectors)
    assert sorted(got["score"].to_pylist()) == sorted(np.sort(total)[-5:].astype(int).tolist())
    assert asked[0] == 3999 and asked[1] < 1500


@pytest.mark.parametrize("kind", ["plain", "ties", "odd", "wide", "few"])
def test_top_k_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS_A_BLOCK", 70)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 2)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(420)]
    if kind == "ties":
        rows = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(420)] + [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(150)]
    if kind == "odd":
        rows += [(600, None), (700, [1.0, None]), (800, [float("nan")]), (900, [float("inf"), 1.0]), (1000, []), (1100, [3.0]), (None, [9.0] * 6), (7, [5.0] * 9)]
    if kind == "wide":
        rows += [(500, [1e8] * 6), (501, [-1e8] * 6), (502, [3e38] * 6), (503, [1e8, 0.3, 0.3, 0.3, 0.3, 0.3])]
    if kind == "few":
        rows = rows[:4] + rows[:1]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=10)
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rounded, 10)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- 9 substrings ----------------------------------------------------------------------------

def test_cover_meets_every_shift():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD))


def test_repeats_equal_brute_force(spark, stored):
    texts = odd_texts()
    shared = prose(70, 90)
    for k in range(50):
        cut = shared[k % 30:k % 30 + 33 + k % 9]  # runs of 33 to 41 words at every shift
        texts.append(" ".join(prose(200 + k, k) + cut + prose(300 + k, 7)))
    docs = stored(documents(spark, texts))
    got = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    for i, (n, gone, digest) in enumerate(substrings.brute_force(texts)):
        kept = re.findall(r"[^\x20\x09-\x0D]+", got[i]["kept_text"])
        assert (got[i]["n_words"], got[i]["n_removed"], hashlib.sha256(" ".join(kept).encode()).hexdigest()) == (n, gone, digest)
        assert got[i]["_note"] == f"x{i}"
        if not gone:
            assert got[i]["kept_text"] == (texts[i] or "")
    assert substrings.remove_repeats(stored(docs.limit(0))).count() == 0


def test_crc_of_ids_is_that_of_zlib(spark):
    ids = np.array([1, 2, 65_000], "<u4").tobytes()
    row = spark.createDataFrame([(ids,)], "ids binary").select(F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(ids)
