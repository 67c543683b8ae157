"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_texts, table

NONE = np.int64(1) << 62
POS = 32
#: Distinct words whose ids a worker keeps; beyond it only those that stand in the texts at hand stay.
KEPT_WORDS = 100_000
#: Leaves of all the trees that are worked on together; bytes from which a word's tree is worked on alone.
LEAVES, ALONE = 1 << 16, 256
# The published byte-level split pattern, white space as Unicode has it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def load_merges(json_path: str) -> dict:
    """Merge table and vocabulary of a byte-level BPE file of the tokenizers library; bounded by the vocabulary."""
    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab = model["vocab"]
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    size = max([*vocab.values(), *added.values()]) + 1
    symbols = byte_symbols()
    pairs = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        pairs.setdefault(vocab[a] * size + vocab[b], (rank, vocab[a + b]))
    keys = np.array(sorted(pairs), np.int64)
    back = {c: b for b, c in enumerate(symbols)}
    strings = [b""] * size
    for s, i in vocab.items():
        strings[i] = bytes(back[c] for c in s)
    for s, i in added.items():
        strings[i] = s.encode()
    made = {rank: symbol for rank, symbol in pairs.values()}
    by_rank = [made.get(k, 0) for k in range(len(model["merges"]))]
    return {"name": json_path, "size": size, "keys": keys, "ranks": np.array([pairs[k][0] for k in keys.tolist()], np.int64), "by_rank": by_rank, "bytes": np.array([vocab[c] for c in symbols], np.int64), "strings": strings, "added": added}


def _leaf(t: dict, a: np.ndarray, b: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rank first, place second: the smallest leaf is the leftmost pair of the lowest rank. NONE where nothing merges."""
    key = a * t["size"] + b
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    return np.where(t["keys"][at] == key, (t["ranks"][at] << POS) | pos, NONE)


def tree_merge(words: list[bytes], t: dict, by_rank: np.ndarray) -> list[bytes]:
    """Ids of each word (32-bit little-endian). All words need the same size of tree, and have two bytes at least.

    Row w of `tree` is the segment tree of word w: leaf i holds the pair that starts at symbol i, node 1 is the root.
    A round takes each root's merge and updates three leaves with their ancestors.
    """
    m = len(words)
    n = np.array([len(w) for w in words], np.int64)
    leaves = 1 << max(1, int(n.max() - 1).bit_length())
    sym = np.zeros((m, leaves + 1), np.int64)
    inside = np.arange(leaves + 1) < n[:, None]
    sym[inside] = t["bytes"][np.frombuffer(b"".join(words), np.uint8)]
    place = np.arange(leaves)
    tree = np.full((m, 2 * leaves), NONE)
    tree[:, leaves:] = np.where(inside[:, 1:], _leaf(t, sym[:, :-1], sym[:, 1:], place), NONE)
    width = leaves // 2
    while width:
        tree[:, width : 2 * width] = tree[:, 2 * width : 4 * width].reshape(m, width, 2).min(2)
        width //= 2
    nxt = np.tile(np.arange(1, leaves + 2), (m, 1))
    prv = np.tile(np.arange(-1, leaves), (m, 1))
    alive = inside.copy()
    row = np.arange(m)
    while True:
        root = tree[row, 1]
        if not (go := root < NONE).all():
            row, root = row[go], root[go]
        if not len(row):
            break
        pos = root & ((1 << POS) - 1)
        made = by_rank[root >> POS]
        gone = nxt[row, pos]
        after = nxt[row, gone]
        sym[row, pos] = made
        alive[row, gone] = False
        nxt[row, pos] = after
        ends = after >= n[row]
        prv[row, np.where(ends, leaves, after)] = pos
        before = prv[row, pos]
        starts = before < 0
        tree[row, leaves + gone] = NONE
        tree[row, leaves + pos] = np.where(ends, NONE, _leaf(t, made, sym[row, np.where(ends, 0, after)], pos))
        changed = [gone, pos]
        if not starts.all():
            before = np.where(starts, pos, before)
            tree[row, leaves + before] = np.where(starts, tree[row, leaves + before], _leaf(t, sym[row, before], made, before))
            changed.append(before)
        changed = [x + leaves for x in changed]
        while changed[0][0] > 1:
            for k, x in enumerate(changed):
                changed[k] = x = x >> 1
                tree[row, x] = np.minimum(tree[row, 2 * x], tree[row, 2 * x + 1])
    ids, many = sym[alive].astype("<u4").tobytes(), np.r_[0, np.cumsum(alive.sum(1))] * 4
    return [ids[many[k] : many[k + 1]] for k in range(m)]


def long_merge(word: bytes, t: dict, pairs: dict[int, int]) -> bytes:
    """Ids of one long word (32-bit little-endian), by the same segment tree as `tree_merge` in plain lists.

    Whole-array steps don't pay for a single merge. A changed leaf is passed up only as far as a node's least leaf changes,
    so most updates end after a few of the logarithmic number of steps.
    """
    n, size, by_rank = len(word), t["size"], t["by_rank"]
    leaves = 1 << (n - 1).bit_length()
    start = t["bytes"][np.frombuffer(word, np.uint8)]
    levels = [np.full(leaves, NONE)]
    levels[0][: n - 1] = _leaf(t, start[:-1], start[1:], np.arange(n - 1))
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(1))
    tree = [int(NONE), *np.concatenate(levels[::-1]).tolist()]
    sym, nxt, prv = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    none, low = int(NONE), (1 << POS) - 1

    def put(at: int, value: int) -> None:
        at += leaves
        tree[at] = value
        while at > 1:
            a, b = tree[at], tree[at ^ 1]
            at >>= 1
            a = a if a < b else b
            if tree[at] == a:
                return
            tree[at] = a

    def leaf(at: int, a: int, b: int) -> int:
        rank = pairs.get(a * size + b)
        return none if rank is None else rank << POS | at

    while (root := tree[1]) < none:
        at = root & low
        gone = nxt[at]
        after, before = nxt[gone], prv[at]
        sym[at] = made = by_rank[root >> POS]
        nxt[at], sym[gone] = after, -1
        put(gone, none)
        if after < n:
            prv[after] = at
            put(at, leaf(at, made, sym[after]))
        else:
            put(at, none)
        if before >= 0:
            put(before, leaf(before, sym[before], made))
    return np.array([x for x in sym if x >= 0], "<u4").tobytes()


def encode_words(words: list[str], t: dict) -> list[bytes]:
    """Ids of each word; words of like length share a round of trees, long ones have their own."""
    raw = [w.encode() for w in words]
    out = [t["bytes"][np.frombuffer(b, np.uint8)].astype("<u4").tobytes() if len(b) < 2 else b"" for b in raw]
    by_rank = np.array(t["by_rank"], np.int64)
    sizes: dict[int, list[int]] = {}
    for k, b in enumerate(raw):
        if len(b) >= ALONE:
            out[k] = long_merge(b, t, _ranks_of(t["name"], t))
        elif len(b) > 1:
            sizes.setdefault(max(1, (len(b) - 1).bit_length()), []).append(k)
    for bits, which in sizes.items():
        step = max(1, LEAVES >> bits)
        for a in range(0, len(which), step):
            some = which[a : a + step]
            for k, ids in zip(some, tree_merge([raw[k] for k in some], t, by_rank)):
                out[k] = ids
    return out


_known_ranks: dict[str, dict[int, int]] = {}


def _ranks_of(name: str, t: dict) -> dict[int, int]:
    """Pair to rank, made once in a worker for a merge table, and only where long words stand."""
    if name not in _known_ranks:
        _known_ranks.clear()
        _known_ranks[name] = dict(zip(t["keys"].tolist(), t["ranks"].tolist()))
    return _known_ranks[name]


def encode_texts(texts: list[str], t: dict, known: dict[str, bytes]) -> list[bytes]:
    """Ids of each text as 32-bit little-endian integers."""
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(t["added"], key=len, reverse=True))) + ")") if t["added"] else None
    split = regex.compile(SPLIT).findall
    known.update((s, np.array([i], "<u4").tobytes()) for s, i in t["added"].items())
    parts = []
    for x in texts:
        if special and special.search(x):
            parts.append([w for k, p in enumerate(special.split(x)) for w in ([p] if k % 2 else split(p))])
        else:
            parts.append(split(x))
    seen = set().union(*parts)
    new = list(seen - known.keys())
    if len(known) + len(new) > KEPT_WORDS:
        again = {w: known[w] for w in seen & known.keys()}
        known.clear()
        known.update(again)
    known.update(zip(new, encode_words(new, t)))
    return [b"".join(map(known.__getitem__, p)) for p in parts]


def decode_ids(ids: bytes, strings: list[bytes]) -> str:
    """The text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(df: DataFrame, json_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text with a byte-level BPE file, then decodes the ids.

    Columns: the id, n_tokens, ids (binary: 32-bit little-endian integers), decoded. A null or empty text has no ids and
    decodes to the empty text; repeated rows give repeated results; texts are taken whole, whatever their length. There
    is no shuffle; the merge table (bounded by the vocabulary) is broadcast.
    """
    t = df.sparkSession.sparkContext.broadcast(load_merges(json_path))

    def run(texts: list[str]) -> list[list]:
        ids = encode_texts(texts, t.value, kept(json_path))
        return [[len(x) // 4 for x in ids], ids, [decode_ids(x, t.value["strings"]) for x in ids]]

    return map_texts(df, id_col, text_col, "n_tokens long, ids binary, decoded string", run)


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids and the decoded text as SHA-256."""
    return df.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict:
    from public_tokenizers import path

    return {"op6_bpe_encode_decode": lambda spark, sf_dir: digests(encode_decode(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json")))}
