"""Corpus operators against the libraries, brute force, exact round trips and held-out rows."""

import collections
import hashlib
import io
import itertools
import os
import random
import re
import tracemalloc
import wave
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from tidewright.llm import ann, bpe, common, graph, langid, lines, media, mixing, nearjoin, quality, substrings, tokens

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "the the the", "line\nline\n\nline", "é漢字😀 \t x", "a" * 5000, "<|endoftext|> <s>", "\x00\x1c\x85"]
WORDS = [w for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()]


def texts(n, words=60, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(words)) for _ in range(n)]


def frame(spark, rows, extra=True):
    """Rows of (text, source) with ids; a column whose name clashes with what operators use inside."""
    data = [(k, t, s, "x") for k, (t, s) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, id string") if extra else spark.createDataFrame([d[:3] for d in data], "doc_id long, text string, source string")


def fuzz(n=200):
    rng = random.Random(3)
    alphabet = " \n\t\rabAB019'.,-<>|éßñ漢😀\x1c\x85\xa0　½"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(n)]


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    all_ = ODD + fuzz() + ["ab" * 300, "".join(random.Random(1).choice("etaoin") for _ in range(3000))]
    got = {r[0]: r for r in tokens.token_counts(frame(spark, [(t, None) for t in all_]), path("piece_bpe_32k.model"), limit=40).collect()}
    for k, t in enumerate(all_):
        n = len(sp.encode(t or ""))
        assert tuple(got[k])[1:] == (len((t or "").encode()), n, n > 40)
    assert tokens.token_counts(frame(spark, []), path("piece_bpe_32k.model")).count() == 0


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    all_ = ODD + fuzz() + ["".join(random.Random(2).choice("etaoin") for _ in range(n)) for n in (255, 256, 257, 3000, 60_000)] + ["a" * 1025, "ab" * 700]
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame(spark, [(t, None) for t in all_]), path("byte_bpe_50k.json")).collect()}
    for k, t in enumerate(all_):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_workers_keep_little():
    """A worker lives through the stages of the pipeline: its words are few, those that recur stay, and those of the stage before go."""
    t, rng = bpe.load_merges(path("byte_bpe_50k.json")), random.Random(2)
    known, often = common.kept("bpe"), " often here"
    want = bpe.encode_texts([often], t, {})
    tracemalloc.start()
    for _ in range(8):
        words = [" " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(50_000)]
        words = ["".join(words[a : a + 500]) + often for a in range(0, len(words), 500)]
        got = bpe.encode_texts(words, t, known)
        assert all(x.endswith(want[0]) for x in got) and " often" in known
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(known) <= 100_000 and peak < 40e6
    assert bpe.encode_texts(words, t, {}) == got
    nearjoin.shingle_set("a b c d e f")
    assert not common.kept("bpe") and not known.keys() & common.kept("shingles").keys()


def test_media_round_trip(spark):
    rows = media.media_columns(frame(spark, [(t, None) for t in ODD + ["same", "same"]])).collect()
    assert len(rows) == len(ODD) + 2
    for r, t in zip(sorted(rows), ODD + ["same", "same"]):
        raw = (t or "").encode()
        want = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        with wave.open(io.BytesIO(r["media"])) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, want)
        batch = pa.ipc.open_stream(r["features"]["tensors"]).read_all()
        assert batch.schema.field("log_mel").type.shape == [media.FRAMES, media.MELS]
        assert batch.num_rows == -(-r["features"]["n_frames"] // media.FRAMES)
    same = [r for r in rows if r["doc_id"] >= len(ODD)]
    assert same[0]["features"] == same[1]["features"]
    digest = media.digests(media.media_columns(frame(spark, [("abc", None)]))).first()
    want = b"abc".ljust(192, b" ")
    assert (digest["payload_sha256"], digest["tail_crc32"]) == (hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))


def test_media_features_match_brute_force():
    x = np.random.default_rng(3).normal(size=2400).astype(np.float32)
    branches, window, filters = media._design()
    padded = np.concatenate([np.zeros(media.TAPS - 1), x.astype(np.float64), np.zeros(2 * media.TAPS)])
    y = np.array([sum(padded[k * media.DOWN // media.UP + j] * float(branches[k * media.DOWN % media.UP][j]) for j in range(media.TAPS)) for k in range(len(x) * media.UP // media.DOWN)])
    assert np.allclose(media.resample(x), y, atol=1e-4)
    want = []
    for a in range(0, len(y) - media.WINDOW + media.HOP, media.HOP):
        f = np.zeros(media.FFT)
        part = y[a : a + media.WINDOW]
        f[: len(part)] = part * window[: len(part)]
        power = [abs(sum(f[n] * np.exp(-2j * np.pi * k * n / media.FFT) for n in range(media.FFT))) ** 2 for k in range(media.FFT // 2 + 1)]
        want.append(np.log(np.array(power) @ filters + media.FLOOR))
    got = media.log_mel(y.astype(np.float32))
    assert got.shape == (len(want), media.MELS) and np.allclose(got, want, atol=0.02)
    energy, on, runs_ = got.mean(1), False, []
    for k, e in enumerate(energy):  # on from mean + half a deviation, off below the mean
        was, on = on, True if e >= energy.mean() + energy.std() / 2 else False if e < energy.mean() else on
        if on and not was:
            runs_.append([k, k])
        if on:
            runs_[-1][1] = k + 1
    assert media.segments(energy).tolist() == runs_


def test_media_edges(spark):
    df = spark.createDataFrame([(1, "b" * 30_000, "m", "f"), (1, "b" * 30_000, "m", "f"), (None, None, "m", "f")], "doc_id long, text string, media string, features string")
    rows = [tuple(r) for r in media.digests(media.media_columns(df)).collect()]
    assert len(rows) == 3 and len(set(rows)) == 2
    assert media.digests(media.media_columns(df.limit(0))).count() == 0


def test_resampler_keeps_a_tone():
    x = np.sin(2 * np.pi * 500 * np.arange(12000) / media.STORED_HZ).astype(np.float32)
    y = media.resample(x)
    assert len(y) == 8000
    assert np.abs(np.fft.rfft(y)).argmax() == 500


def test_mix_matches_sql(spark):
    rng = random.Random(5)
    rows = [(" ".join("w" for _ in range(rng.randrange(30))), rng.choice(["a", "b", "b", "b", "ç", None])) for _ in range(300)] + [(None, "a"), ("", "z"), (" x\t y ", "z")]
    got = sorted(tuple(r) for r in mixing.mix(frame(spark, rows)).select("doc_id", "size", "source_size", "target", "copies").collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(k, t, s) for k, (t, s) in enumerate(rows)])
    want = sorted(c.execute(mixing.MIX_SQL.replace("{docs}", "documents") + "SELECT id, size, source_size, target, copies FROM k").fetchall())
    assert got == want
    assert max(r[4] for r in got) <= 3
    assert sum(r[1] for r in got) == pytest.approx(sum({(r[2], r[3]): r[3] for r in got}.values()))
    assert sorted(r["doc_id"] for r in mixing.mixed_documents(frame(spark, rows)).collect()) == sorted(k for r in got for k in [r[0]] * r[4])
    assert mixing.mix(frame(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_mix_comes_near_its_targets(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect()
    off = sorted(abs(r["n"] - r["t"]) / r["t"] for r in rows)  # fifty documents a source, of 1 to 20,000 words
    assert len(off) > 3 and off[len(off) // 2] <= 0.01 and off[-1] <= 0.12


def test_mix_edges(spark):
    df = spark.createDataFrame([(None, "a b", None, 1, 1), (None, "a b", None, 1, 1), (3, None, "s", 1, 1), (4, "x " * 5000, "s", 1, 1)], "doc_id long, text string, source string, copies int, row int")
    got = mixing.mix(df).collect()
    assert sorted(r["size"] for r in got) == [0, 2, 2, 5000] and max(r["copies"] for r in got) <= 3
    assert set(mixing.mixed_documents(df).columns) == set(df.columns)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}


def near_brute(rows):
    sets, best = [], {}
    for t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(nearjoin.lower))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    best = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    best[i] = best[j] = min(best[i], best[j])
    return [(k, len(s), b, k == b) for k, (s, b) in enumerate(zip(sets, best))]


@pytest.mark.parametrize("leaf,large", [(800, 4096), (3, 6), (3, 4096)])
def test_near_groups_match_brute_force(spark, monkeypatch, leaf, large):
    monkeypatch.setattr(nearjoin, "LEAF", leaf)
    monkeypatch.setattr(nearjoin, "LARGE", large)
    monkeypatch.setattr(nearjoin, "LEVELS", 3)
    rng, rows = random.Random(9), texts(12, 80)
    for t in rows[:4]:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), None, "", "two words", "Two  words", "two words more"]
    got = sorted(tuple(r) for r in nearjoin.near_groups(frame(spark, [(t, None) for t in rows])).collect())
    assert got == near_brute(rows)
    assert nearjoin.near_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("leaf,large,rounds", [(800, 4096, 4), (5, 4096, 1), (5, 12, 2)])
def test_leaders_lose_no_links(spark, monkeypatch, leaf, large, rounds):
    """Crowded nodes: two groups of near-copies that share roots, a chain of edits, outsiders with half of the text, repeated rows."""
    for name, value in (("LEAF", leaf), ("LARGE", large), ("CROWD", 4), ("ROUNDS", rounds), ("LEVELS", 3)):
        monkeypatch.setattr(nearjoin, name, value)
    rng = random.Random(17)
    base, other = texts(2, 100, 41)
    mixed = " ".join(base.split()[:70] + other.split()[70:])
    rows = [other]
    for t in (base, mixed):
        for k in range(20):
            w = t.split()
            w[rng.randrange(len(w))] = f"own{k}"
            rows.append(" ".join(w))
    w = base.split()
    for k in range(12):  # each text is like the one before, the last is unlike the first
        w[(k * 8 + 3) % 100] = f"step{k}"
        rows.append(" ".join(w))
    rows += [" ".join(base.split()[:50] + x.split()[:50]) for x in texts(10, 60, 42)] + [rows[1], rows[1], None, ""]
    links = []
    real = nearjoin.led

    def spy(*args):
        out = real(*args)
        links.append(out[0].count())
        return out

    monkeypatch.setattr(nearjoin, "led", spy)
    got = sorted(tuple(r) for r in nearjoin.near_groups(frame(spark, [(t, None) for t in rows])).collect())
    assert got == near_brute(rows) and links[0] >= 15


def test_small_tables_take_few_tasks(spark):
    """Nodes of a few sets are not dealt over all partitions of the session: each task leaves files and events on disk."""
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "50")
    wide.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = nearjoin.features(frame(wide, [(texts(1, 40, 5)[0] + end, None) for end in ("", " a", " b")]), "doc_id", "text", False)
    nodes = nearjoin.roots(rows.select("key", "sig"))
    assert nodes.count() > 3 and nodes.rdd.getNumPartitions() == 1


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_line_dedup(spark):
    base = texts(6, 25, seed=4)
    near = base[0].replace(base[0].split()[0], base[0].split()[0] + "s", 1)
    rows = ["\n".join(base[:3]), "\n".join([base[1].upper() + "!", "", base[4]]), near, None, "", "\n\n", base[5] + "\n" + base[5], "other words\n" + base[2]]
    df = frame(spark, [(t, None) for t in rows])
    got = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert [got[k]["text"] for k in (0, 3, 4, 5)] == [rows[0], None, "", "\n\n"]
    assert got[1]["text"] == "\n" + base[4] and got[2]["text"] == "" and got[6]["text"] == base[5] and got[7]["text"] == "other words"
    assert [got[k]["removed_"] for k in range(8)] == [0, 1, 1, 0, 0, 0, 1, 1] and [got[k]["lines_"] for k in range(8)] == [3, 3, 1, 0, 1, 3, 2, 2]
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_edges(spark):
    a, b = texts(2, 20, seed=14)
    rows = [(None, a, "g", 1), (None, a, "g", 2), (3, b, "g", 3), (3, b, "g", 4), (4, a + "\n" + b, "g", 5), (5, " ".join([a] * 900), "g", 6), (6, " ".join([a] * 900) + " end", "g", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, removed_ int")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "gone", "lines_", "removed_"]
    got = sorted(out.select(F.coalesce("doc_id", F.lit(-1)), "text", "gone", "removed_").collect())
    # rows that share an id are one document and keep the same lines; the least id (null first) keeps a line
    assert [tuple(r) for r in got] == [(-1, a, "g", 0)] * 2 + [(3, b, "g", 0)] * 2 + [(4, "", "g", 2), (5, rows[5][1], "g", 0), (6, "", "g", 1)]


def test_near_lines_go(spark):
    rng, base = random.Random(12), [" ".join(x.split()[:n]) for n in (3, 5, 8, 12, 25, 60) for x in texts(12, n, seed=n)] + ["漢字仮名交" * 9 + str(k) * 8 for k in range(3)]
    near = []
    for x in base:
        w = x.split()
        for _ in range(max(1, len(w) // 20)):
            k = rng.randrange(len(w))
            w[k] = w[k] + "s"
        near.append(" ".join(w))
    rows = base + near
    norm = [x.lower() for x in rows]
    want = list(range(len(rows)))
    find = lambda k: k if want[k] == k else find(want[k])
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * abs(len(norm[i]) - len(norm[j])) <= max(len(norm[i]), len(norm[j])) and len(set(norm[i].split()) & set(norm[j].split())) * 2 + 2 >= len(norm[i].split()) and 10 * distance(norm[i], norm[j]) <= max(len(norm[i]), len(norm[j]))]
    assert len(links) >= len(base)
    for i, j in links:
        i, j = find(i), find(j)
        want[max(i, j)] = min(i, j)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(spark, [(x, None) for x in rows])).collect()}
    gone = {k for k in got if got[k] == ""}
    must = {k for k in range(len(rows)) if find(k) != k}
    assert gone <= must and len(gone) >= 0.95 * len(must)


def test_crowded_line_keys(spark, monkeypatch):
    """Lines of one template, half of whose words are common, in small groups of like lines."""
    monkeypatch.setattr(lines, "CROWD", 3)
    common, rows = " ".join(texts(1, 14, 61)), []
    for x in texts(14, 14, 62):
        for k in range(3):
            w = x.split()
            w[k * 4] += "s"
            rows.append(common + " " + " ".join(w))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(spark, [(x, None) for x in rows])).collect()}
    assert sum(bool(x) for x in got.values()) <= 16 and all(any(got[k + j] for j in range(3)) for k in range(0, len(rows), 3))


@pytest.mark.parametrize("pairs", [10, 60])
def test_all_lines_of_a_key_meet(spark, monkeypatch, pairs):
    """Lines with all keys in common, which only short words tell apart: rows up to CROWD lines, blocks beyond it; long and odd ones among them."""
    monkeypatch.setattr(lines, "BLOCK_LINES", 50, raising=False)
    rng, common, rows = random.Random(15), " ".join(f"{w}word" for w in WORDS[:16]), []
    for k in range(pairs):
        own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(14 + 60 * (k == 3))]
        rows += [f"{common} {' '.join(own)}", f"{common} {' '.join(own[:7] + ['zé'] + own[8:])}"]
    keys = {tuple(sorted(r["keys"])) for r in lines.keyed_lines(frame(spark, [(x, None) for x in rows]), "doc_id", "text").collect()}
    assert len(keys) == 1
    root = list(range(len(rows)))
    far = duckdb.connect().execute("SELECT x.i, y.i FROM (SELECT unnest(?) t, unnest(range(?)) i) x, (SELECT unnest(?) t, unnest(range(?)) i) y WHERE x.i < y.i AND 10 * levenshtein(x.t, y.t) <= greatest(length(x.t), length(y.t))", [rows, len(rows)] * 2).fetchall()
    for i, j in sorted(far):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(spark, [(x, None) for x in rows])).collect()}
    assert len(far) >= pairs and {k for k in got if got[k]} == set(root)


def test_links_past_large_roots(spark, monkeypatch):
    """Pairs that all share half of their text with very many others, so most roots branch."""
    monkeypatch.setattr(nearjoin, "LARGE", 40)
    monkeypatch.setattr(nearjoin, "LEAF", 16)
    common, rows = texts(1, 120, 31)[0], []
    for k, own in enumerate(texts(120, 120, 32)):
        w = own.split()
        w[60] = "changed"
        w[90] = "changed"
        rows += [common + " " + own, common + " " + " ".join(w)]
    got = {r["doc_id"]: r["component_id"] for r in nearjoin.near_groups(frame(spark, [(t, None) for t in rows])).collect()}
    want = {r[0]: r[2] for r in near_brute_pairs(rows)}
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)


def near_brute_pairs(rows):
    return [(k, 0, k - k % 2) for k in range(len(rows))]


def test_near_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "k", 1), (None, "a b c d e f", "k", 1), (2, "a b c d e f", "k", 1), (3, "x " * 50_000, "k", 1), (3, None, "k", 1)], "doc_id long, text string, key string, n int")
    got = nearjoin.near_groups(df).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["n_shingles"] == 2} == {2}
    assert sorted(r["n_shingles"] for r in got) == [0, 1, 2, 2, 2]


def test_pairs_meet_past_a_branched_root(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "LARGE", 6)
    monkeypatch.setattr(nearjoin, "LEVELS", 3)
    rng, rows, pairs = np.random.default_rng(6), [], set()
    for p in range(20):  # a pair that shares 45 of 64 hashes, all roots among them, and strangers in its first root only
        s = rng.integers(0, 1 << 32, (10, 64), dtype=np.uint64).astype("<u4")
        s[:, 0] = s[0, 0]
        same = np.r_[np.arange(12), 12 + rng.choice(52, 33, replace=False)]
        s[1, same] = s[0, same]
        rows += [(bytes([p, k]), 100, s[k].tobytes()) for k in range(10)]
        pairs |= {bytes([p, 0]), bytes([p, 1])}
    reps = spark.createDataFrame(rows, "key binary, n long, sig binary")
    got = nearjoin.with_partners(nearjoin.leaves(reps).join(reps, "key")).collect()
    assert {bytes(r["key"]) for r in got} == pairs


def test_pipeline_lines_of_a_crowded_key_meet(spark, monkeypatch):
    """40 lines with all keys in common make 20 groups of two, none of which is near the least line of the key."""
    import corpus_pipeline

    monkeypatch.setattr(lines, "CROWD", 8)
    rng, common, rows = random.Random(16), " ".join(f"{w}word" for w in WORDS[:16]), []
    for _ in range(20):
        own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(14)]
        rows += [f"{common} {' '.join(own)}", f"{common} {' '.join(own[:7] + ['zé'] + own[8:])}"]
    out = corpus_pipeline.dedup_lines(spark, frame(spark, [(x, None) for x in rows]), "")
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 40, 2))


def test_counts_of_characters_bound_edits(spark):
    rng, t = random.Random(6), ["", "e" * 300, "te" * 200, "漢字 é e", "e e"]
    t += ["".join(rng.choice("etaoxyz é") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    rows = spark.createDataFrame([(x, len(x)) for x in t], "norm string, size int").withColumns(lines.bags(F.col("norm"), F.col("size")))
    end = lambda c: rows.select(*(F.col(x).alias(f"{x}_{c}") for x in rows.columns))
    got = end("x").crossJoin(end("y")).select("norm_x", "norm_y", lines.least_edits("x", "y").alias("least"), F.levenshtein("norm_x", "norm_y").alias("far")).collect()
    assert all(r["least"] <= r["far"] for r in got) and sum(r["least"] > 0.5 * r["far"] for r in got) > len(got) / 4


def test_lines_are_normalised_and_keyed_in_one_pass(spark):
    """Texts are read once for the lines with their keys, and once for the lines that are compared."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    df = frame(spark, [(f"{texts(1, 12, 5)[0]} {end}", None) for end in "ab"]).select("doc_id", counted.asNondeterministic()("text").alias("text"))
    assert lines.line_groups(df).count() == 2 and seen.value == 2 * 2


def test_alignment_settles_lines_that_repeat_themselves(spark):
    """Long lines of one word or of one sentence, with changed words and a sentence more, are links by the sums of their pieces, which are never below their distance."""
    rng, t = random.Random(7), []
    for s in (["thor"], texts(1, 30, 77)[0].split()):
        x = s * (600 // len(s))
        for k in rng.sample(range(len(x)), 20):
            x[k] = "other"
        t += [(" ".join(s * (600 // len(s))), " ".join(x)), (" ".join(s * (600 // len(s))), " ".join(x + s))]
    rows = spark.createDataFrame(t, "s string, t string").withColumn("most", F.floor(F.length("t") / 10).cast("int"))
    least = F.least(*(fn(F.col("s"), F.col("t"), F.col("most")) for fn in (lines.edits_by_characters, lines.edits_by_words)))
    got = rows.select("most", F.levenshtein("s", "t").alias("far"), least.alias("pieces")).collect()
    assert all(r["far"] <= r["pieces"] <= r["most"] for r in got)


def test_line_keys_take_few_tasks(spark):
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "50")
    wide.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = frame(wide, [(f"{texts(1, 12, 5)[0]} {end}", None) for end in "ab"])
    members = lines.key_members(df, lines.keyed_lines(df, "doc_id", "text"), "doc_id", "text")
    assert members.count() > 3 and members.rdd.getNumPartitions() == 1


def test_line_keys_match_brute_force(spark):
    t = texts(60, 5, seed=8) + texts(60, 12, seed=9) + texts(20, 40, seed=10) + ["a b", "one", "漢字仮名交" * 9]
    t += [" ".join(x.split()[:-1] + ["end"]) for x in t[:140]]
    df = frame(spark, [(x, None) for x in t])
    got = {r["id"]: set(r["keys"]) for r in lines.keyed_lines(df, "doc_id", "text").collect()}
    hashed = {r["w"]: r["h"] for r in df.select(F.explode(F.split("text", " ")).alias("w")).distinct().withColumn("h", F.xxhash64("w")).collect()}
    for k, x in enumerate(t[:140]):
        h = sorted((hashed[w] & (1 << 63) - 1) if len(w) <= lines.FREQUENT else (hashed[w] | -(1 << 63)) for w in set(x.split()))[: lines.BLOCKS]
        want = set()
        blocks = [[h[(a + j) % len(h)] for j in range(lines.BLOCK)] for a in range(len(h)) if len(h) >= lines.SHORT - 1]
        blocks += itertools.combinations(h, lines.SHORT_BLOCK) if len(h) < lines.SHORT else []
        for some in blocks:
            want.add(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in some) > len(some)))
        assert {v & (1 << 64) - 1 for v in got[k]} == want
    for k in range(60, 140):  # one changed word leaves a block
        assert got[k] & got[k + 143]


def test_edit_similarity_matches_brute_force(spark):
    rng, base = random.Random(5), texts(6, 60, seed=21) + [" ".join(["para"] * 300), " ".join(texts(1, 30, 3) * 12)]
    t = list(base)
    for x in base:
        for n in (1, 2, 4, 8, 12):
            w = x.split()
            for _ in range(n):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = rng.choice([[], ["new"], ["two", "more"]])
            t.append(" ".join(w))
    pairs = [(i, j) for i in range(len(t)) for j in range(i) if abs(len(t[i]) - len(t[j])) < 200]
    rows = spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(t)], "a long, norm string, size int")
    got = {tuple(r) for r in lines.edited(spark.createDataFrame(pairs, "x long, y long"), rows, 0.9).collect()}
    c = duckdb.connect()
    far = lambda i, j: c.execute("SELECT levenshtein(?, ?)", [t[i], t[j]]).fetchone()[0]
    assert got == {(i, j) for i, j in pairs if 10 * far(i, j) <= max(len(t[i]), len(t[j]))}


@pytest.mark.parametrize("align_from", [1, 10**9])
def test_alignment_changes_no_link(spark, align_from):
    """Lines of 5 to 300 characters, with and without shared words, are links by their distance only, however they are told apart."""
    rng = random.Random(8)
    t = [x[:n] for n in (5, 7, 8, 40, 300) for x in texts(2, 60, seed=n)]
    t += ["".join(rng.choice("abc de") if rng.random() < share else c for c in x) for x in t for share in (0.03, 0.12)]
    pairs = [(i, j) for i in range(len(t)) for j in range(i) if abs(len(t[i]) - len(t[j])) < 2]
    rows = spark.createDataFrame([(k, x, len(x)) for k, x in enumerate(t)], "a long, norm string, size int")
    got = {tuple(r) for r in lines.edited(spark.createDataFrame(pairs, "x long, y long"), rows, 0.9, align_from).collect()}
    c = duckdb.connect()
    far = lambda i, j: c.execute("SELECT levenshtein(?, ?)", [t[i], t[j]]).fetchone()[0]
    assert got and got == {(i, j) for i, j in pairs if 10 * far(i, j) <= max(len(t[i]), len(t[j]))}


def test_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 20)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 20), (2002, [float("nan")] + [1.0] * 19), (2003, [None] + [1.0] * 19)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len({v for v, _ in got[q]} & set(np.argsort(-s)[:5].tolist()))
        assert all(abs(score - s[v]) < 1e-12 for v, score in got[q]) and q not in dict(got[q])
    assert set(got) == set(range(0, 1500, 50)) and hit >= 0.9 * 150
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(few, F.col("id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(few.limit(0), F.col("id") == 0).count() == 0


def test_search_ties_copies_and_lone_queries(spark):
    rng = np.random.default_rng(8)
    one = rng.normal(size=16).astype(np.float32)
    near = one + 1e-3 * rng.normal(size=(400, 16)).astype(np.float32)
    far = rng.normal(size=(300, 16)).astype(np.float32)
    rows = [(k, one.tolist()) for k in range(3000)] + [(3000 + k, v.tolist()) for k, v in enumerate(near)] + [(3400 + k, v.tolist()) for k, v in enumerate(far)] + [(9000, [1.0] * 7), (9050, [1.0] * 7), (None, one.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("key", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == set(range(0, 3700, 50)) and all(len(v) == 5 for v in got.values())
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4]
    x = np.array([v for _, v in rows[:3700]], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = lambda q: [k for k in np.lexsort((np.arange(3700), -np.round(u @ u[q], 12))).tolist() if k != q][:5]
    assert sum(len(set(got[q]) & set(true(q))) for q in got) >= 0.95 * 5 * len(got)


def test_search_measures_its_reach_in_the_table(spark):
    rng = np.random.default_rng(5)
    w, scale = rng.integers(40, size=8000), 10.0 ** rng.uniform(-4, 0, size=40)
    x = (rng.normal(size=(40, 64))[w] + scale[w][:, None] * rng.normal(size=(8000, 64))).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(4)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    true = lambda q: [k for k in np.argsort(-(u @ u[q]))[:6].tolist() if k != q][:5]
    assert sum(len(set(got[q]) & set(true(q))) for q in range(0, 8000, 50)) >= 0.955 * 5 * 160


def test_compiled_rules_match_holds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    model = quality.fit(x, y)
    assert len(model["rules"]) > 3
    want = 1 / (1 + np.exp(-(model["bias"] + sum(w * quality.holds(x, r) for r, w in model["rules"]))))
    stats = F.struct(*(F.col("v")[k].alias(n) for k, n in enumerate(quality.STATISTICS))).alias("stats")
    got = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>").select("k", stats).select("k", quality.compiled(model).alias("p")).orderBy("k").collect()
    assert np.allclose([r["p"] for r in got], want, atol=1e-12)
    assert ((want >= 0.5) == y).mean() > 0.95


def test_model_edges(spark):
    df = spark.createDataFrame([(None, "the house and the garden " * 4000, "en", 1), (2, "the house", "en", 1), (2, "the house", "en", 1), (3, "", "en", 1), (4, None, None, 1)], "doc_id long, text string, lang string, stats int")
    labels = spark.createDataFrame([(2, 1), (None, 1)], "doc_id long, quality int")
    scored = quality.score(df, quality.train(df, labels)).collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 for r in scored)
    found = langid.predict(df, langid.train(df)).collect()
    assert len(found) == 5 and {r["lang_pred"] for r in found} == {"en", "und"}
    assert quality.score(df.limit(0), {"bias": 0.0, "rules": []}).count() == langid.predict(df.limit(0), langid.train(df)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_models_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = langid.train(docs)
    held = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = langid.predict(held, model).join(held, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    odd = {r["doc_id"]: r for r in langid.predict(frame(spark, [(t, None) for t in [None, "", "12 ½ !", "the house"]]), model).collect()}
    assert [odd[k]["lang_pred"] for k in range(3)] == ["und"] * 3 and odd[3]["lang_pred"] != "und"
    assert langid.predict(frame(spark, [("x", None)]), langid.train(docs.limit(0))).first()["lang_pred"] == "und"
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.95 * len(scored)
    blank = quality.score(frame(spark, [(None, None), ("", None)]), {"bias": 0.0, "rules": []}).collect()
    assert [r["score"] for r in blank] == [0.5, 0.5]


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    score, move = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[True, True, True, False]])
    want, moves, total = np.zeros((3, 3)), np.zeros((3, 3)), 0
    for a in range(3):
        for b in range(3):
            for c in range(3):
                p = np.exp(score[0, 0, a] + score[0, 1, b] + score[0, 2, c] + move[a, b] + move[b, c])
                total += p
                want[[0, 1, 2], [a, b, c]] += p
                moves[a, b] += p
                moves[b, c] += p
    got, pairs = langid.forward_backward(score, mask, move, True)
    assert np.allclose(got[0, :3], want / total) and np.allclose(pairs, moves / total)


def removed_brute(rows):
    raw = [(t or "").encode() for t in rows]
    n = collections.Counter(r[k : k + 200] for r in raw for k in range(len(r) - 199))
    out = []
    for i, r in enumerate(raw):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if n[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        out.append((i, len(r), int(gone.sum()), len(substrings.runs(gone)), np.frombuffer(r, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("contexts", [3000, 2])
def test_substrings_match_brute_force(spark, monkeypatch, contexts):
    monkeypatch.setattr(substrings, "CONTEXTS", contexts)
    passage, rows = " ".join(texts(1, 70, 6)), texts(10, 60, 7)
    rows += [r[:90] + passage[:260] + r[90:] for r in rows[:6]] + [passage[k:] for k in (0, 5, 190)] + [rows[0], rows[0], None, "", "é" * 150, "é" * 99, "a" * 199, "a" * 230]
    got = sorted(tuple(r) for r in substrings.remove_repeats(frame(spark, [(t, None) for t in rows])).collect())
    assert [(*r[:4], bytes(r[4])) for r in got] == removed_brute(rows)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_order():
    t = np.r_[np.random.default_rng(1).integers(97, 100, 3000), 0].astype(np.uint8)
    raw = t.tobytes()
    got = [raw[i : i + 200] for i in substrings.suffix_order(t)]
    assert got == sorted(raw[i : i + 200] for i in range(len(raw)))


def test_substring_edges(spark):
    a = texts(1, 80, 41)[0]
    df = spark.createDataFrame([(None, a, 1, "r"), (None, a, 1, "r"), (3, "lead " + a, 1, "r"), (4, ("ab" * 5000), 1, "r"), (5, None, 1, "r")], "id long, text string, n int, run string")
    got = sorted(tuple(r)[1:] for r in substrings.remove_repeats(df, id_col="id").collect())
    assert [(*r[:3], bytes(r[3])) for r in got] == sorted(r[1:] for r in removed_brute([a, a, "lead " + a, "ab" * 5000, None]))


def test_stage_edges(spark):
    import corpus_pipeline as p

    a, b = texts(2, 30, 51)
    rows = [(1, a, "en", "s", 9, "x", "x"), (1, a, "en", "s", 9, "x", "x"), (1, a + " more", "en", "s", 9, "x", "x"), (2, b, "en", None, 9, "x", "x"), (3, None, None, "s", 0, "x", "x"), (4, "", "en", "s", 0, "x", "x"), (None, b + " and so", "en", "t", 9, "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, language_ string, removed_ string")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.collect() is not None
        assert stage(spark, docs.limit(0), "").count() == 0
    near = p.dedup_near(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0) for r in near) == [0, 1, 3, 4]  # a null id is the least


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.count()
    texts_ = [r["text"] for r in kept.select("doc_id", "text").distinct().collect()]
    assert len([t for t in texts_ if len(t.split()) > 8]) == len({t for t in texts_ if len(t.split()) > 8})
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in kept.collect())
