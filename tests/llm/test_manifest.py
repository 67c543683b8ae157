"""Merkle manifests, I-Match fingerprints and whitening against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tidewright.llm import imatch, merkle, whitening

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Levels of digests from the leaves up, and the siblings of each leaf."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([sha("".join(a[k : k + 2])) for k in range(0, len(a), 2)])
    paths = [[(a[j], j < (k >> n)) if (j := (k >> n) ^ 1) < len(a) else ("", False) for n, a in enumerate(levels[:-1])] for k in range(len(nodes))]
    return levels[-1][0], paths


def manifest_brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    leaf = lambda r: sha("".join(map(part, r)))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs]
    roots, paths = zip(*(tree([leaf(r) for r in g]) for g in groups))
    root, above = tree(list(roots))
    out = []
    for g, group in enumerate(groups):
        for r, path in zip(group, paths[g]):
            path = path + above[g]
            at = leaf((*r[:3], r[3] + 1, r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None else r)
            for s, left in path:
                at = sha(s + at if left else at + s)
            out.append((r[0], leaf(r), roots[g], root, sha("".join(s for s, _ in path)), at, at == root))
    return out


def keyed(rows):
    return sorted(map(tuple, rows), key=repr)


def manifest_rows(spark, rows):
    data = [(*r, "x", "y", 1, "z") for r in rows]
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, place int, key string")
    return keyed(merkle.verified(*merkle.manifest(df)).drop("path").collect())


def test_merkle(spark):
    long = "é漢" * 30_000
    rows = [(k, "s" if k % 3 else None, "en", k, f"text {k}") for k in range(131)]
    rows += [(200 + k, "s", g, 9, "t") for g, n in ((None, 3), ("", 64), ("é", 65), ("z", 1)) for k in range(n)]
    rows += [(None, None, None, None, None), (5, "s", "en", None, ""), (5, "s", "en", None, ""), (5, "t", "de", 4, long), (6, "t", "de", 4, None)]
    got = manifest_rows(spark, rows)
    assert got == keyed(manifest_brute(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_merkle_small(spark, n):
    rows = [(k, "s", "en", 1, "t") for k in range(n)]
    assert manifest_rows(spark, rows) == (keyed(manifest_brute(rows)) if n else [])


def test_merkle_stores_few_levels(spark):
    rows = [(k, "s", "en", 1, "t") for k in range(200)]
    trees, top = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert [t.count() for t in trees] == [200, 4, 1] and [t.count() for t in top] == [1]


def imatch_brute(rows):
    """rows: doc_id, text, all different. Gives the columns of fingerprints()."""
    terms = lambda t: set(re.split(imatch.APART, t.lower())) - {''}
    texts = [t or "" for _, t in rows]
    n = len(rows)
    found = {}
    for t in texts:
        for w in terms(t):
            found[w] = found.get(w, 0) + 1
    inside = {w for w, k in found.items() if -(-n // imatch.RARE) <= k <= n // imatch.COMMON}

    def hashes(text):
        words = terms(text) & inside or terms(text)
        one = lambda some: hashlib.md5(" ".join(sorted(some, key=str.encode)).encode()).digest()[: imatch.BYTES] if some else bytes(imatch.BYTES)
        path = {w: "".join(str(int(c, 16) // 4) for c in sha(w)[: imatch.DEPTHS - 1]) for w in words}
        return [[one({w for w in words if path[w].startswith(prefix)}) for prefix in some] for some in imatch.PREFIXES]

    def like(a, b):
        if a == b:
            return 1.0
        none = bytes(imatch.BYTES)
        parts = [[0 if x == y == none else 2 if x == y else 1 for x, y in zip(*both)] for both in zip(a, b)]
        for some in ([s for p in parts[1:] if 0 in p for s in p], sum(parts, [])):
            if any(some):
                return some.count(2) / sum(s > 0 for s in some)

    out = []
    for k, (id_, _) in enumerate(rows):
        t, after = texts[k], texts[(k + 1) % n]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = hashes(t), hashes(edited), hashes(after)
        out.append((id_, len(t), sha(edited), b"".join(sum(a, [])).hex(), b"".join(sum(b, [])).hex(), like(a, b), like(a, c)))
    return out


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus():
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"{rng.choice(WORDS)}{rng.integers(40)}" for _ in range(rng.integers(1, 90)))) for k in range(60)]
    return [(None, "before all"), *rows, (60, None), (61, ""), (62, rows[3][1]), (63, rows[3][1]), (64, " .,! "), (65, "Ünï 漢字 漢字 x\nÜNÏ"), (66, "a"), (67, "the " * 3000 + "end")]


def imatch_rows(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], "doc_id long, text string, place_ int, id_ string, term string")
    return keyed(imatch.fingerprints(df).collect())


@pytest.mark.parametrize("most", [imatch.BROADCAST, 12, 0])
def test_imatch(spark, monkeypatch, most):
    """By broadcast; by shuffle with common terms told before; by shuffle alone."""
    monkeypatch.setattr(imatch, "BROADCAST", most)
    rows = corpus() + [(100 + k, f"common shared {k}") for k in range(12)]
    got = imatch_rows(spark, rows)
    assert got == keyed(imatch_brute(rows))
    near = {r[0]: r for r in got}
    assert near[62][3] == near[63][3] == near[3][3] and near[62][6] == 1.0


def test_imatch_repeats_and_empty(spark):
    rows = corpus()[:12]
    once, twice = imatch_rows(spark, rows), imatch_rows(spark, rows + [rows[4], rows[0]])
    assert len(twice) == len(once) + 2 and {r[:3] for r in twice} == {r[:3] for r in once}
    assert imatch_rows(spark, []) == []
    ((_, n, _, a, b, near, following),) = imatch_rows(spark, [(1, "one two three four")])
    assert (n, following) == (18, 1.0) and a != b and near < 1


def white(spark, vectors, **options):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, component string, n int")
    return whitening.whiten(df, **options)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(300, 20)) * np.r_[np.linspace(3, 1, 12), np.ones(8) * 0.1]
    bad = [None, [None] + [1.0] * 19, [float("nan")] * 20, [float("inf")] * 20, [1.0] * 3, []]
    got = white(spark, [*good.tolist(), *bad, good[0].tolist()]).toPandas()
    x = np.floor(np.r_[good, good[:1]] * 1024).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    v = np.cov(x.T, bias=True)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    ids = [*range(300), 306]
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = (x - sums / n) @ q / np.sqrt(e)
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-9)
    assert set(got["vec_id"]) == set(ids) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    exact = got[got["component"] == 1].set_index("vec_id").loc[ids]["deviation"]
    assert [int(d) for d in exact] == ((n * x - sums) ** 2).sum(axis=1).tolist()
    assert np.allclose(got.groupby("component")["explained"].first(), e / np.trace(v), rtol=1e-9)
    assert got["residual"].max() < 1e-12 * e[0]


def test_whitening_edges(spark):
    assert white(spark, []).count() == 0 and white(spark, [None, []]).count() == 0
    alone = white(spark, [[1.0, 2.0]]).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    line = white(spark, [[float(k), 2.0 * k, 0.0] for k in range(5)]).toPandas()
    assert line[line["component"] == 1]["whitened"].notna().all() and line[line["component"] > 1]["whitened"].isna().all()
    assert abs(line["explained"].max() - 1) < 1e-12 and line["identity_error"].max() < 1e-9
    with pytest.raises(Exception, match="too large"):
        white(spark, [[1e300]]).collect()


def test_eigenvectors_of_multiple_values():
    """A space that starts with too few copies of an eigenvalue still finds all."""
    rng = np.random.default_rng(0)
    for d, spectrum in ((200, np.r_[np.full(10, 5.0), rng.random(190)]), (64, np.ones(64)), (40, np.zeros(40)), (90, 1 / np.arange(1, 91))):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        v = (q * spectrum) @ q.T
        values, vectors, residuals = whitening.leading(lambda u, v=v: v @ u, d, 8)
        assert np.allclose(values, np.sort(spectrum)[::-1][:8], atol=1e-12) and residuals.max() <= 1e-12
        assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
