"""The corpus operators against brute force: what their methods add, and the cases their docstrings define."""

import collections
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, embed_dedup, html_extract, mixing, ngram_join, pii, quality, queries, secrets, sentencepiece_bpe, sharding

SF = "/root/testdata/sf0.001"

# --- html


def site(host: str, n: int, rng: random.Random) -> list[tuple]:
    """Pages without any mark of structure: only recurrence tells the site's parts from the text."""
    words = "river stone light calm meadow cloud winter harbour lantern copper".split()
    text = lambda k: " ".join(rng.choices(words, k=k))
    menu = "".join(f"<div><a href=/{w}>{w} {host}</a></div>" for w in words[:5])
    page = "<body><div>{menu}</div><div>Welcome to {host}</div><div><h1>{title}</h1><p>{one}</p><p>{two}</p></div><div>All rights {host}</div></body>"
    return [(f"http://{host}/{k}", page.format(menu=menu, host=host, title=text(4), one=text(12), two=text(9))) for k in range(n)]


def test_templates_decide(spark):
    rng = random.Random(1)
    pages = [p for h, n in (("a.example", 6), ("b.example", 30), ("c.example", 2)) for p in site(h, n, rng)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    without = {k: html_extract.extract(p) for k, (_, p) in enumerate(pages)}
    for k, (_, p) in enumerate(pages):
        own = re.search(r"<h1>(.*?)</h1><p>(.*?)</p><p>(.*?)</p>", p).groups()
        if k < 36:
            assert got[k] == "\n".join(own) and got[k] != without[k]
        else:
            assert got[k] == without[k]  # two pages do not make a site


def test_templates_inside_articles(spark):
    box = "<div class='x7'>Read this elsewhere</div>"
    page = "<article><h1>Head {k}</h1><p>Own {k}</p>{box}<p>Follow our paper</p><ul><li>point</ul></article>"
    rows = [(k, f"http://d.example/{k}", page.format(k=k, box=box)) for k in range(30)]
    rows += [(100 + k, f"http://e.example/{k}", page.format(k=k, box=box if k < 3 else "")) for k in range(10)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    assert all(got[k] == f"Head {k}\nOwn {k}" for k in range(30))  # on every one of many pages
    assert got[100] == "Head 0\nOwn 0\nRead this elsewhere\nFollow our paper\npoint"  # on three of ten, and ten are few
    assert got[109] == "Head 9\nOwn 9\nFollow our paper\npoint"


def test_template_counts_equal_a_recount(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").collect()]
    pages += site("f.example", 25, random.Random(2)) + site("f.example", 25, random.Random(2))[:5]
    by_host = collections.defaultdict(dict)
    for url, page in pages:
        nodes = html_extract.parse(page)
        html_extract.measure(nodes)
        by_host[re.match(r"https?://([^/?#]*)", url)[1].lower()][page] = html_extract.subtrees(nodes)
    want = {}
    for host, own in by_host.items():
        for h, n in collections.Counter(h for found in own.values() for h in found).items():
            share = n / len(own)
            if n >= html_extract.PAGES and share >= html_extract.SHARE:
                want[host, h] = 3 if share >= html_extract.MOST and len(own) >= html_extract.MANY else 2 if share >= html_extract.SITE else 1
    df = spark.createDataFrame(pages, "url string, html string").repartition(4)
    assert {(r["host"], r["hash"]): r["level"] for r in html_extract.templates(df).collect()} == want and len(want) > 20


def test_pages_that_break_parsers():
    said = html_extract.extract
    assert said('<body class="no-sidebar"><article><p>Hello world</p></article></body>') == "Hello world"
    assert said('<div class="post with-share"><p>Body text</p></div>') == "Body text"
    assert said('<div class="site-footer">x</div><div class="cookie-notice">y</div><p>z</p>') == "z"
    assert said("İİİ<script>var a='<p>';</script><p>Text</p>") == "İİİ\nText" and said("a < b > c") == "a < b > c"
    assert said('<a title="x>link</a><p>more') == "link\nmore" and said("plain <text") == "plain <text" and said(None) == ""
    start = time.time()
    for page in ("<div>" * 30000 + "deep", "<a " * 100_000, '<a b="x>" ' * 30000 + "'", "<b>" * 9000 + "<td></td>" * 9000, "<i><div>" + "<b>" * 9000 + "</i>" * 9000, "<p " + "a" * 200_000 + ">x"):
        nodes = html_extract.parse(page)
        html_extract.measure(nodes)
        said(page, {1: 2})
    assert said("<div>" * 30000 + "deep") == "deep" and time.time() - start < 30


# --- personal data


def cued(rng: random.Random) -> list[str]:
    names = ["ann.lee", "bob_77", "carla-m", "d.okoro"]
    return [
        f"{rng.choice(['Please mail', 'contact me:', 'write to'])} {rng.choice(names)}{k} (at) site{k % 7}.{rng.choice(['com', 'org', 'zzz'])} or "
        f"{rng.choice(['call', 'phone', 'order no', 'invoice'])} ({200 + k}) {555 - k % 300}-{1000 + k} and mail a{k}@b.com, ip 10.0.{k % 256}.7, tel +1 415 555 {1000 + k}"
        for k in range(300)
    ]


def test_pii_model_equals_plain_expectation_maximisation(spark):
    """The same rounds in numpy over the same candidates; then its decisions, one by one."""
    df = spark.createDataFrame(list(enumerate(cued(random.Random(3)))), "doc_id bigint, text string").repartition(3)
    found = pii.candidates(df)
    rows = [(r["doc_id"], c) for r in found.collect() for c in r["found"]]
    at = np.array([c["votes"] + c["shape"] for _, c in rows])

    def estimate(w: np.ndarray, n: int) -> tuple:
        one = lambda x: [np.array([(x[at[:, j] == v].sum() + 1) / (x.sum() + pii._VALUES[j]) for v in range(pii._VALUES[j])]) for j in range(n)]
        return (w.sum() + 1) / (len(w) + 2), one(w), one(1 - w)

    def posterior(model: tuple, n: int) -> np.ndarray:
        prior, pos, neg = model
        odds = math.log(prior) - math.log(1 - prior) + sum(np.log(pos[j][at[:, j]]) - np.log(neg[j][at[:, j]]) for j in range(n))
        return 1 / (1 + np.exp(-odds))

    model = estimate(1 / (1 + np.exp(-(at[:, :4].sum(1) - 4.0))), 4)
    for _ in range(pii.ROUNDS):
        model = estimate(posterior(model, 4), 4)
    model = estimate(posterior(model, 4), 7)
    got = pii.fit(found).first()["model"]
    assert abs(got["prior"] - model[0]) < 1e-9
    assert all(np.allclose(a, b, atol=1e-9) for side, own in (("pos", model[1]), ("neg", model[2])) for a, b in zip(got[side], own))
    sure = posterior(model, 7) >= 0.5
    want = {(d, pii.KINDS[c["kind"]], c["start"], c["end"]) for (d, c), ok in zip(rows, sure) if c["strict"] or ok}
    spans = {(r["doc_id"], *s) for r in pii.find(df).collect() for s in r["spans"]}
    base = {(d, pii.KINDS[c["kind"]], c["start"], c["end"]) for d, c in rows if c["strict"]}
    assert base < spans <= want
    assert all(any(b[0] == w[0] and b[1] == w[1] and b[2] < w[3] and w[2] < b[3] for b in base) for w in want - spans)


def test_pii_labelers(spark):
    said = {
        0: "mail x.y@abc.com", 1: "version x.y@abc.zzz", 2: "host 10.0.0.1", 3: "9.1.1.1", 4: "visa 4111 1111 1111 1111", 5: "call +49 30 1234567", 6: "aaaa@aa.com",
    }
    df = spark.createDataFrame(list(said.items()), "doc_id int, text string")
    got = {r["doc_id"]: [c["votes"] for c in r["found"]] for r in pii.candidates(df).collect()}
    # pattern, gazetteer, cue words, shape
    assert got[0] == [[2, 2, 2, 2]] and got[1] == [[2, 0, 0, 2]] and got[2][0][1:3] == [2, 2] and got[3][0][1:] == [0, 1, 0]
    assert got[4][0][:3] == [2, 2, 2] and got[5][0][:3] == [2, 2, 2] and got[6][0][2:] == [1, 1]


def test_pii_many_matches(spark):
    text = " ".join(f"mail é{k} a{k}@b{k % 9}.com;" for k in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    start = time.time()
    base = pii.find(df).first()["base"]
    assert [(s["start"], s["end"]) for s in base] == [m.span() for m in re.finditer(r"a\d+@b\d\.com", text)] and time.time() - start < 60


# --- secrets

PLAIN = [
    ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[1]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, lambda m: len(m[0]) >= 40), ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, lambda m: len(m[0]) >= 15),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, lambda m: len(m[0]) >= 39), ("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, lambda m: True),
]


def plain_secrets(text: str) -> list[tuple]:
    found = [(m.start(), k, m.end()) for k, (_, p, flags, ok) in enumerate(PLAIN) for m in re.finditer(p, text, flags) if ok(m)]
    return [(PLAIN[k][0], a, b) for a, k, b in sorted(found)]


def test_one_pass_equals_each_rule_by_itself():
    rng = random.Random(1)
    bits = [
        "token", "secret", "api_key", "APIKEY", "passwd", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEFGH12345678", "ghp_", "a" * 36, "xoxb-", "1-2",
        "AIza", "x" * 35, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "é", "\n", ".", "/", "ſecret", "🙂",
    ]
    seen = set()
    for _ in range(8000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        got = secrets.scanner().spans(text)
        assert got == plain_secrets(text), text
        seen |= {k for k, _, _ in got}
    assert seen == {k for k, *_ in PLAIN}
    start = time.time()
    assert len(secrets.scanner().spans("é deadbeefdeadbeef " * 20000)) == 20000 and time.time() - start < 5


def test_spans_replace_a_column_of_that_name(spark):
    df = spark.createDataFrame([(1, "deadbeef" * 3, "old"), (1, None, None)], "doc_id int, text string, spans string")
    out = secrets.scan_documents(df, keep=("doc_id", "spans"))
    assert out.columns == ["doc_id", "spans"] and sorted(len(r["spans"]) for r in out.collect()) == [0, 1]


# --- quality


def test_quality_on_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(k % 20, f"{'good fine' if k % 2 else 'bad poor'} text {k}", 0.0) for k in range(4000)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id bigint, quality int")
    models = [quality.fit(x, labels) for x in (df, df.repartition(7).unionByName(df))]
    assert np.array_equal(models[0].weights, models[1].weights)
    out = quality.score_documents(df, models[0])
    assert out.columns == ["doc_id", "text", "score"] and all((r["score"] >= 0.5) == r["text"].startswith("good") for r in out.collect())


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


# --- sharding, mixing


def test_shards_have_near_equal_bytes_by_the_stored_map(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = str(tmp_path / "map")
    sharding.write_slot_map(sharding.first_slot_map(spark, 4), path)
    rows = sharding.shard(docs, 4, map_path=path).collect()
    filled = collections.Counter()
    for r in rows:
        filled[r["shard"]] += r["size"]
    assert max(filled.values()) - min(filled.values()) <= max(r["size"] for r in rows) and len(filled) == 4
    stored = {v: {r["virtual_slot"]: r["shard"] for r in sharding.read_slot_map(spark, path, v).collect()} for v in (1, 2)}
    assert all(stored[2][r["virtual_slot"]] == r["shard"] for r in rows) and stored[1] != stored[2] and len(stored[1]) == len(stored[2]) == sharding.N_SLOTS
    assert sharding.rebalance(spark, path, sharding.slot_bytes(sharding.records(docs)), 4, slack=0.05) == 2  # even enough now
    assert len({r["shard"] for r in sharding.shard(docs, 5, map_path=path).collect()}) == 5  # a new number of shards: version 3
    assert spark.read.parquet(path).select("version").distinct().count() == 3
    nulls = sharding.shard(docs.withColumn("doc_id", F.lit(None).cast("bigint")), 4).collect()
    assert len(nulls) == docs.count() and len({r["shard"] for r in nulls}) == 4


def test_mix_targets_and_amounts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    words = {r["doc_id"]: len(re.findall(mixing.WORD, r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == words
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 * total and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 0.01 * total
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    small = mixing.mix(docs, shards=2, shard_rows=8)  # more shards where rows are many
    assert abs(sum(r["taken"] for r in small.collect()) - total) <= 0.05 * total


# --- vectors


def test_ann_over_several_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(36_000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4)
    rows = ann.search(df, F.col("vec_id") % 720 == 0, 20).collect()
    x, hit = x.astype(np.float64), 0
    for q in range(0, 36_000, 720):
        own = [r for r in rows if r["query_id"] == q]
        assert len(own) == len({r["vec_id"] for r in own}) == 20 and all(abs(r["score"] - x[q] @ x[r["vec_id"]]) < 1e-12 for r in own)
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({r["vec_id"] for r in own} & set(np.argsort(-s)[:20].tolist()))
    assert hit / len(rows) >= 0.9


def test_ann_on_repeated_rows(spark):
    x = np.random.default_rng(4).normal(size=(60, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[0].tolist()), (5, x[5].tolist()), (7, (-x[7]).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = ann.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    for q in (0, 20, 40):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        best = {k: float(x[q] @ v) for k, v in enumerate(x) if k != q}
        best[7] = abs(best[7])
        assert [r["vec_id"] for r in own] == sorted(best, key=lambda k: (-best[k], k))[:20]


def test_near_dedup_on_repeats_and_extreme_doubles(spark):
    rows = [(1, [1e200, 0.0]), (1, [0.0, 1e-200]), (2, [3e180, 1e170]), (3, [0.0, 5.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0]), (5, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(2)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4), (5, 0, 5)]


# --- shingles


def test_groups_that_are_cut(spark):
    """One group of near copies with a few texts apart from the most, cut into many pieces."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(160):
        copy = list(base)
        for _ in range(k % 4):
            copy[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append(" ".join(copy + base[:5] * (k % 11 == 0) + [f"y{j}" for j in range(k % 17)]))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in rows]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    for piece, weight in ((16, 1 << 21), (1000, 900)):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(df, piece=piece, weight=weight).collect()}
        assert [got[k] for k in range(len(rows))] == root
    assert 1 < len(set(root)) < len(rows)


# --- tokens


def test_what_is_remembered_is_bounded(monkeypatch):
    model = sentencepiece_bpe.MergeModel(queries.piece_model())
    want = [model.coded(f"word{k % 50} " + "x" * k) for k in range(400)]
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 2000)
    small = sentencepiece_bpe.MergeModel(queries.piece_model())
    assert [small.coded(f"word{k % 50} " + "x" * k) for k in range(400)] == want
    assert small._held <= 2000 + 1200 and all(len(s) <= sentencepiece_bpe.LONG for s in small._known)


def test_every_document_as_the_library_codes_it(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    coded = sentencepiece_bpe.encode_documents(docs, queries.piece_model()).join(docs.select("doc_id", "text"), "doc_id")

    def wrong(batches):
        import pyarrow as pa

        for b in batches:
            ids = sp.encode([t.as_py() or "" for t in b.column(2)])
            bad = [x.as_py() != i or d.as_py() != sp.decode(i) for x, d, i in zip(b.column(0), b.column(1), ids)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(bad)], pa.int64()), pa.array([len(bad)], pa.int64())], names=["bad", "n"])

    assert tuple(coded.select("ids", "decoded", "text").mapInArrow(wrong, "bad bigint, n bigint").agg(F.sum("bad"), F.sum("n")).first()) == (0, docs.count())


# --- pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, from the smallest documents with some odd ones added."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    first = docs.orderBy("doc_id").limit(1)
    again = docs.where("length(text) > 300").orderBy("doc_id").limit(2)
    odd = again.unionByName(first.withColumn("text", F.lit(None).cast("string"))).unionByName(again.withColumn("doc_id", F.lit(None).cast("bigint")))
    folder, got = tmp_path_factory.mktemp("stages"), [docs.unionByName(odd)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, got[-1], SF).write.parquet(str(folder / str(k)))
        got.append(spark.read.parquet(str(folder / str(k))))
    return [[r.asDict() for r in df.collect()] for df in got], got


def counted(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def test_pipeline_quality_and_copies(spark, stages):
    rows, frames = stages
    model = quality.fit(frames[0], spark.read.parquet(f"{SF}/labels.parquet"))
    good = [r for r in rows[0] if model.score(r["text"]) >= 0.5]
    assert counted(rows[1], "doc_id", "text") == counted(good, "doc_id", "text") and len(good) < len(rows[0])
    sets = []
    for r in good:
        w = re.findall(mixing.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(good)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(good)):
        for b in range(a):
            same = good[a]["doc_id"] is not None and good[a]["doc_id"] == good[b]["doc_id"]
            if same or sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    lowest = {}
    for k, r in enumerate(good):
        if r["doc_id"] is not None:
            lowest[find(k)] = min(lowest.get(find(k), r["doc_id"]), r["doc_id"])
    want = {(r["doc_id"], r["text"]) for k, r in enumerate(good) if r["doc_id"] is not None and lowest[find(k)] == r["doc_id"]}
    assert counted((r for r in rows[2] if r["doc_id"] is not None), "doc_id", "text") == collections.Counter(want)
    assert counted((r for r in rows[2] if r["doc_id"] is None), "text") == counted((r for r in good if r["doc_id"] is None), "text")


def test_pipeline_secrets_mix_and_tokens(stages):
    import sentencepiece

    rows, _ = stages

    def masked(text):
        out, at = [], 0
        for _, a, b in plain_secrets(text or ""):
            if a >= at:
                out += [text[at:a], "[secret]"]
            at = max(at, b)
        return text and "".join(out) + text[at:]

    want = collections.Counter((r["doc_id"], masked(r["text"]), None if r["text"] is None else len(masked(r["text"]))) for r in rows[2])
    assert counted(rows[3], "doc_id", "text", "n_chars") == want
    words = lambda r: len(re.findall(mixing.WORD, r["text"] or ""))
    before, after = counted(rows[3], "doc_id", "text"), counted(rows[4], "doc_id", "text")
    assert set(after) <= set(before) and all(n <= 3 * before[k] + 1 for k, n in after.items()) and all(words(r) for r in rows[4])
    total = sum(map(words, rows[3]))
    assert abs(sum(map(words, rows[4])) - total) <= 0.25 * total
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    ids = collections.Counter((r["doc_id"], tuple(sp.encode(r["text"])), sp.decode(sp.encode(r["text"]))) for r in rows[4])
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows[5]) == ids and all(r["n_tokens"] == len(r["ids"]) for r in rows[5])
