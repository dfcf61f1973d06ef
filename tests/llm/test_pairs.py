"""Operators 3, 6 and 10."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pumpline.llm import components, minhash, neighbours, urls

SF = "/root/testdata/sf0.001"


def brute_components(texts: dict, k: int, percent: int) -> tuple[dict, dict]:
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or "")) if x]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sorted(texts) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def near(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out: list = [None, "", " \n", "one", "One", "one two", "a b c", "A  b\tc", "x y z"]
    for edits in (0, 1, 2, 3, 4, 5, 6):
        base = [f"v{rng.randrange(10**6)}" for _ in range(90)]
        out += [near(rng, base, edits) for _ in range(12)]
    shared = [f"s{i}" for i in range(60)]
    out += [" ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(25)]) for _ in range(30)]
    out += ["of the " * 5000, "of the " * 5000 + "end"]
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_op10_against_brute_force(spark, docs, texts, k, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    order = list(range(len(texts)))
    random.Random(k).shuffle(order)
    rows = minhash.linked(docs([(i, texts[i], "en", "s", 0) for i in order], extra=True), k, percent).collect()
    component, size = brute_components(dict(enumerate(texts)), k, percent)
    assert {r.doc_id: r.component_id for r in rows} == component
    assert {r.doc_id: r.n_shingles for r in rows} == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op10_odd_tables(spark, docs):
    assert minhash.linked(docs([])).count() == 0
    rows = minhash.linked(docs([(None, "a b c d", "en", "s", 0), (1, "a b c d", "en", "s", 0), (1, "a b c d", "en", "s", 0), (2, "a b c d", "en", "s", 0)])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in rows) == sorted([(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=lambda x: x[0])
    kept = minhash.deduplicated(docs([(None, "a b", "en", "s", 0), (1, "a b", "en", "s", 0), (2, "a b", "en", "s", 0)], extra=True), 3, 85)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert minhash.sketch(a).max() < np.iinfo(np.uint64).max
    both = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    more = rng.integers(0, 1 << 63, (2, 100), dtype=np.uint64)
    same = np.mean([(minhash.sketch(np.r_[both, more[0]] + np.uint64(i)) == minhash.sketch(np.r_[both, more[1]] + np.uint64(i))).mean() for i in range(20)])
    assert abs(same - 900 / 1100) < 0.03


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2040)]
    parent = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: p for x, p in parent.items() if x in got} and all(p == x for x, p in parent.items() if x not in got)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query long")


def brute_neighbours(rows, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in ok:
        if i % every == 0:
            found = sorted(((-round(float(v @ w) / np.sqrt((v @ v) * (w @ w)), 12), j) for j, w in ok if j != i))[:k]
            out[i] = [j for _, j in found]
    return out


@pytest.mark.parametrize("queries", [4096, 3])
def test_op6_neighbours(spark, monkeypatch, queries):
    monkeypatch.setattr(neighbours, "SHARD", 100)
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], i) for i in range(900)]
    rows += [(i, [1.0] * 8, 0) for i in range(900, 1200)]
    rows += [(1200, None, 0), (1250, [0.0] * 8, 0), (1300, [float("nan")] * 8, 0), (1350, [1.0, None] + [1.0] * 6, 0), (1400, [1.0], 0), (None, [1.0] * 8, 0)]
    rng.shuffle(rows)
    got = collections.defaultdict(list)
    for r in sorted(neighbours.nearest(vectors(spark, rows)).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    expect = brute_neighbours(rows, 50, 5)
    assert set(got) == set(expect) and all([x[0] for x in v] == [1, 2, 3, 4, 5] for v in got.values())
    hit = sum(len({x[1] for x in got[q]} & set(e)) for q, e in expect.items())
    assert hit >= 0.9 * 5 * len(expect)
    assert [x[1] for x in got[900]] == [901, 902, 903, 904, 905] and [x[1] for x in got[1150]] == [900, 901, 902, 903, 904]
    assert all(abs(x[2] - 1) < 1e-12 for x in got[900])


def test_op6_ties_go_to_the_smaller_id(spark):
    """Multiples of one vector, and different vectors that are equally near."""
    rows = [(i, [1.0 * (i + 1), 2.0 * (i + 1), 0.0, 0.5 * (i + 1)], 0) for i in range(120)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(vectors(spark, rows)).collect())
    assert got == [(q, k + 1, v) for q in (0, 50, 100) for k, v in enumerate([x for x in range(6) if x != q][:5])]
    around = [(0, [1.0, 0.0, 0.0, 0.0], 0), *((i, [1.0, *(0.25 * (1 if (i - 1) // 2 == j else 0) * (-1) ** i for j in range(3))], 0) for i in range(1, 7))]
    assert [r.vec_id for r in sorted(neighbours.nearest(vectors(spark, around)).collect(), key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]


def test_op6_verifies_few_of_clustered_vectors():
    rng = np.random.default_rng(8)
    raw = np.repeat(rng.standard_normal((40, 64)), 100, axis=0) + 0.2 * rng.standard_normal((4000, 64))
    matrix, ratio = neighbours.projection(64), neighbours.chi_square_bound(neighbours.CONFIDENCE, neighbours.PROJECTED)
    shard = neighbours.Shard(raw, [[i] for i in range(len(raw))], matrix)
    cosines, hit = shard.unit @ shard.unit.T, 0
    for i in range(0, 4000, 50):
        found = {j for j, _ in shard.search(raw[i], matrix, 6, 4.0, ratio)}
        hit += len(found & set(np.argsort(-cosines[i])[:6].tolist())) - 1
    assert hit >= 0.9 * 5 * 80 and shard.verified < 0.1 * 80 * 4000


def test_op6_goes_to_few_shards_of_clustered_vectors(spark, monkeypatch):
    """Over many shards: rounds from the nearest cells on stop early, and find what brute force finds."""
    routes = []
    written = neighbours.written

    def counted(df, name):
        out = written(df, name)
        if name == "routes":
            routes.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "written", counted)
    monkeypatch.setattr(neighbours, "SHARD", 64)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 64))
    raw = (np.repeat(centres, 60, axis=0) + 0.15 * rng.standard_normal((3600, 64))).astype(np.float32).astype(float)
    got = collections.defaultdict(set)
    for r in neighbours.nearest(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(raw)])).collect():
        got[r.query_id].add(r.vec_id)
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    hit = sum(len({j for j in np.argsort(-(unit @ unit[q]), kind="stable")[:6].tolist() if j != q} & got[q]) for q in range(0, 3600, 50))
    assert set(got) == set(range(0, 3600, 50)) and hit >= 0.9 * 5 * 72
    assert sum(routes) < 72 * 56 / 4, routes  # a quarter of all queries times shards


def test_op6_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    raw = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.embedding is not None}
    ids = sorted(raw)
    unit = np.array([raw[i] / np.linalg.norm(raw[i]) for i in ids])
    hit, got = 0, collections.defaultdict(set)
    for r in neighbours.nearest(df).collect():
        got[r.query_id].add(r.vec_id)
        a, b = raw[r.query_id], raw[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    for q in got:
        cosines = unit @ (raw[q] / np.linalg.norm(raw[q]))
        hit += len({ids[j] for j in np.argsort(-cosines)[:6]} - {q} & got[q])
    assert hit >= 0.9 * sum(map(len, got.values()))


def test_op6_few_rows(spark):
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    rows = neighbours.nearest(vectors(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1)])).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in rows) == [(1, 1, 0.0), (2, 2, -1.0)]
    assert neighbours.nearest(vectors(spark, [(0, [1.0], 1)])).count() == 0


def test_chi_square_bound():
    assert neighbours.chi_square_bound(0.95, 12) == pytest.approx(21.026, abs=1e-3)


def brute_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x.group(0).lower(), host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_op3_rules(spark):
    some = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "https://example.org/en/12?x#y", "http://example.org/en/2", "http://badexample.org/es/", "http://a.example.com/fr/x", "http://com/de/", "http://acom/de/", "a://b://c/d", "http://x.org?es/", "http://x.net/" + "p/" * 20000, "http://ÄX.com/de/1\n2"]
    rows = {r.page_id: r for r in urls.judged(spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(some)], "page_id long, url string, template int, label int")).collect()}
    for i, u in enumerate(some):
        host, path, rule, verdict = brute_url(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == (verdict or "allow")
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def bucket(segment):
    if segment is None:
        return urls.BUCKETS
    h = xxhash.xxh64_intdigest(segment.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % urls.BUCKETS


def brute_templates(rows):
    """The tree of templates as the docstring has it, in plain Python: (counts, templates) by host and shape."""
    tree = collections.defaultdict(lambda: [0, 0, 0])
    for host, shape, label in rows:
        c = tree[host, tuple(shape)]
        c[0] += 1
        c[1] += label is True
        c[2] += label is False
    template, left, level = {k: "" for k in tree}, set(tree), 0
    while True:
        shapes = collections.Counter((k[0], template[k]) for k in left)
        for k in list(left):
            if shapes[k[0], template[k]] == 1 or len(k[1]) <= level:
                template[k] += "".join("/" + x for x in k[1][level:])
                left.remove(k)
        if not left:
            return tree, template
        children, whole = collections.defaultdict(collections.Counter), collections.Counter()
        for k in left:
            children[k[0], template[k], k[1][level]][bucket(k[1][level + 1] if level + 1 < len(k[1]) else None)] += tree[k][0]
        for k in tree:
            whole[k[0], template[k]] += tree[k][0] if k in left else 0
        shorter = collections.Counter()
        for k in tree:  # urls that end at a node count for it too
            if k not in left and len(k[1]) == level:
                shorter[k[0], template[k]] += tree[k][0]
        names = brute_names(children, {k: whole[k] + shorter[k] for k in whole})
        for k in left:
            template[k] += "/" + names[k[0], template[k], k[1][level]]
        level += 1


def brute_names(children, whole):
    kinds, pools, branches, family = collections.Counter(), collections.defaultdict(collections.Counter), collections.Counter(), {}
    for (host, t, part), c in children.items():
        family[host, t, part] = f = min(i for i in c if c[i] == max(c.values()))
        kinds[host, t] += 1
        pools[host, t, f].update(c)
        branches[host, t, f] += 1
    out = {}
    for (host, t, part), c in children.items():
        f = family[host, t, part]
        n, pool = sum(c.values()), pools[host, t, f]
        total = sum(pool.values())
        chi = sum((c[x] - n * v / total) ** 2 / (n * v / total) for x, v in pool.items())
        many = kinds[host, t] >= urls.MANY and kinds[host, t] > whole[host, t] * urls.SHARE
        out[host, t, part] = "*" if many else f"{{{f}}}" if branches[host, t, f] > 1 and chi <= urls.SIMILAR else part
    return out


def test_op3_labels_carry_over_to_similar_branches(spark):
    """The rule blocks /de/ of a host; /at/, of which no rule speaks, is built like it, /help/ isn't."""
    some = [f"http://shop.com/{lang}/item/{i % 7}{x}.html" for lang in ("de", "at") for i in range(60) for x in "abc"]
    some += [f"http://shop.com/help/{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(3)] * 2
    some += [f"http://other.com/{p}/item/{i}" for p in ("fr", "it") for i in range(50)]
    df = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    rows = {r.page_id: r for r in urls.judged(df).collect()}
    of = lambda host, part: {(r.rule, r.verdict) for r in rows.values() if r.host == host and r.path.split("/")[1] == part}
    assert of("shop.com", "de") == {("com/de/", "block")} and of("shop.com", "at") == {(None, "block")}
    assert of("other.com", "fr") == {("com/fr/", "allow")} and of("other.com", "it") == {(None, "allow")}
    assert len(rows) == len(some)
    return_ = [r.template for r in urls.templates(df.select(urls.host_of(F.col("url")).alias("host"), urls.shape_of(urls.path_of(F.col("url"))).alias("shape"), F.lit(None).cast("boolean").alias("label"))).collect()]
    assert any(t.startswith("/{") for t in return_)


def test_op3_deep_paths_and_repeated_rows(spark):
    deep = "/".join(f"s{i}" for i in range(12))
    rows = [(1, f"http://a.net/{deep}/x")] * 3 + [(2, f"http://a.net/{deep}/y/z"), (3, f"http://a.net/{deep}")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = [(r.page_id, r.verdict) for r in urls.judged(df).collect()]
    assert sorted(got) == [(1, "allow")] * 3 + [(2, "allow"), (3, "allow")]
    shapes = df.select(F.lit("h").alias("host"), urls.shape_of(urls.path_of(F.col("url"))).alias("shape"), F.lit(None).cast("boolean").alias("label"))
    found = {r.template for r in urls.templates(shapes).collect()}
    assert found == {"/" + re.sub("[0-9]+", "<n>", deep) + x for x in ("", "/x", "/y/z")}


def test_op3_templates(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(1500):
        host = rng.choice(["a.net", "b.net"])
        kind = rng.choice(["shop", "blog", "news", "ads"])
        tail = {"shop": [f"item-{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"], "blog": ["post", "<n>"], "news": ["post", "<n>"], "ads": ["click"]}[kind]
        label = {"ads": True, "blog": None, "news": None, "shop": rng.choice([None, False])}[kind]
        rows.append((host, [kind, *tail], label if rng.random() < 0.7 else None))
    tree = urls.templates(spark.createDataFrame(rows, "host string, shape array<string>, label boolean"))
    got = {(r.host, tuple(r.shape)): r.template for r in tree.collect()}
    counts, expect = brute_templates(rows)
    assert got == expect
    assert any("*" in t for t in got.values()) and any("{" in t for t in got.values())
    bad = {(r.host, tuple(r.shape)) for r in urls.rejected(tree).collect()}
    assert bad == {(h, ("ads", "click")) for h in ("a.net", "b.net")}
