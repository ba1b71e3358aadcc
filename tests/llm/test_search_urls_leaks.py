import random
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlens.llm import decontam, neighbours, urls

VECTORS = "vec_id long, embedding array<float>, label int"
BENCH = "item_id long, text string"


def brute_nearest(rows, every, k):
    ok = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok:
        if q % every == 0:
            a = np.array(v, np.float32).astype(float)
            near = {}
            for i, u in ok:
                if i != q and len(u) == len(v):
                    b = np.array(u, np.float32).astype(float)
                    near[i, u] = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
            out[q] = sorted(((-s, i) for (i, _), s in near.items()))[:k]
    return out


def test_recall_and_scores_on_driver_vectors(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    want = brute_nearest(rows, 50, 5)
    for share, least, low in ((1.0, 4096, 0.97), (0.5, 200, 0.85)):
        got = neighbours.nearest(t, shard=700, share=share, least=least).collect()
        assert {r.query_id for r in got} == set(want)
        hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
        assert hits / sum(map(len, want.values())) >= low
        assert sorted((r.query_id, r["rank"]) for r in got) == [(q, n) for q in sorted(want) for n in range(1, 6)]


def test_ties_copies_and_vectors_that_take_no_part(spark):
    r = random.Random(1)
    vec = lambda: [r.gauss(0, 1) for _ in range(8)]
    hot = vec()
    rows = [(k, hot if k % 3 == 0 else vec(), 0) for k in range(300)]
    rows += [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [1.0, None] + [0.0] * 6, 0), (1150, [float("nan")] + [1.0] * 7, 0),
             (1200, [float("inf")] + [1.0] * 7, 0), (1250, [], 0), (None, hot, 0), (1300, [1.0, 2.0], 0), (1301, [1.0, 2.5], 0), (299, rows[299][1], 0)]
    t = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as v", "2 as shard", "3 as score").repartition(4)
    got = neighbours.nearest(t, shard=100)
    want = brute_nearest(rows, 50, 5)
    by = {}
    for x in got.collect():
        by.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert set(by) == {q for q, n in want.items() if n}
    for q, near in by.items():
        assert [i for _, i, _ in sorted(near)] == [i for _, i in sorted((round(s, 12), i) for s, i in want[q])]
        assert np.allclose([s for _, _, s in sorted(near)], [-s for s, _ in want[q]])
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_forest_descends_to_the_longest_prefix():
    x = np.random.default_rng(2).normal(size=(500, 16))
    f = neighbours.Forest(x, trees=4, bits=16)
    q = x[:7] + 0.1
    strings, own = f.strings(q), f.strings(x)
    for k, got in enumerate(f.candidates(q, 40)):
        for depth in range(16, -1, -1):  # all trees ascend together
            hit = [np.flatnonzero(own[t] >> np.uint64(16 - depth) == strings[t, k] >> np.uint64(16 - depth)) for t in range(4)]
            if sum(map(len, hit)) >= 40:
                break
        assert got.tolist() == np.unique(np.concatenate(hit)).tolist()


ODD_URLS = [None, "", "no scheme here", "http://", "http://A.Example.COM", "http://a.example.com/", "http://a.example.com/en", "HTTP://WWW.Example.com/en/x?q=/es/",
            "https://x.net/es/1#y", "https://x.net/fr/1", "https://x.net/es", "https://notnet/es/", "https://net/es/", "ftp://u@h.org:8/p/?a://b", "http://x.com?y=1/z",
            "http://x.com#f/g", "http://ÀÉ.Com/Ü", "http://a://b.net/es/", "http://myexample.com/en/1", "http://h.www.example.com/en/1", "http://a\nb.com/c\nd?e"]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        tail = rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for kind, rule in urls.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()
    rows = [(r.page_id, r.url) for r in pages] + [(10_000 + k, u) for k, u in enumerate(ODD_URLS)]
    t = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as rule", "2 as host").repartition(3)
    got = {r.page_id: r for r in urls.judge(t).collect()}
    assert len(got) == len(rows)
    for k, u in rows:
        host, path, best = brute_rule(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best[1] if best else None)
        assert got[k].verdict == (best[0] if best else "allow" if got[k].llr >= got[k].cut else "block")
        if u and host and "\n" not in u and u.count("://") == 1 and "@" not in u and host.isascii():
            assert host == urlsplit(u).netloc.lower()
    assert got[10_000].llr == 0 and got[10_001].llr == 0


def test_language_models_tell_kinds_of_urls_apart(spark):
    r = random.Random(3)
    word = lambda a: "".join(r.choice(a) for _ in range(8))
    rows = [(k, f"http://{word('abcde') if k % 2 else word('vwxyz')}.{['com', 'net'][k % 2 == 0]}/{'' if k % 2 else 'es/'}{word('abcde') if k % 2 else word('vwxyz')}") for k in range(400)]
    rows += [(1000 + k, f"http://{word('abcde') if k % 2 else word('vwxyz')}.org/{word('abcde') if k % 2 else word('vwxyz')}") for k in range(100)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).filter("rule is null").collect()
    assert len(got) == 100 and np.mean([x.verdict == ("allow" if x.page_id % 2 else "block") for x in got]) > 0.95


def test_smoothed_probabilities_by_brute_force():
    train, query = ["ab", "abc", "b"], "abd"
    grams, contexts = {}, {}
    pad = "\x02" * urls.ORDER
    for u in train:
        for i in range(len(u)):
            for k in range(urls.ORDER + 1):
                c = (pad + u)[urls.ORDER + i - k: urls.ORDER + i]
                contexts.setdefault(c, []).append(u[i])
                grams[c, u[i]] = grams.get((c, u[i]), 0) + 1
    _, cs, gs, _ = urls.slots(train)
    gram, context, kinds = (np.zeros(1 << urls.BITS) for _ in range(3))
    for c, g in zip(cs, gs):
        np.add.at(gram, g, 1)
        np.add.at(context, c, 1)
        for a, _ in {*zip(c.tolist(), g.tolist())}:
            kinds[a] += 1
    _, cq, gq, _ = urls.slots([query])
    got = urls.Markov(gram, context, kinds).log_p(cq, gq)
    for i in range(len(query)):
        p = 1 / 256
        for k in range(urls.ORDER + 1):
            c = (pad + query)[urls.ORDER + i - k: urls.ORDER + i]
            n, t = len(contexts.get(c, [])), len(set(contexts.get(c, [])))
            p = (grams.get((c, query[i]), 0) + (t + 0.01) * p) / (n + t + 0.01)
        assert np.isclose(got[i], np.log(p))


def test_scores_stay_exact_with_many_distinct_grams(spark, monkeypatch):
    r = random.Random(4)
    path = lambda a, n: "".join(r.choice(a) for _ in range(n))
    rows = [(k, f"http://{path('abcdefghijkl', 6)}.{('com', 'net', 'org')[k % 3]}/{('', 'es/', 'é')[k % 3]}{path('abcdefghijklmnopqrstuvwxyz0123456789', 40)}") for k in range(6000)]
    rows += [(6000, "http://a.org/" + "ab" * 500), (6001, "http://a.org/" + "ab" * 500), (6002, "")]
    monkeypatch.setattr(urls, "FREQUENT", 100, raising=False)  # most windows go through the join
    got = {x.page_id: x for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(4)).collect()}
    late = {x.page_id for x in spark.createDataFrame(rows, "page_id long, url string").filter(urls.crc_mod("page_id", 5) == 4).collect()}
    models = {}
    for kind in ("allow", "block"):
        grams, total, kinds = {}, {}, {}
        for k, u in rows:
            if k not in late and got[k].rule and got[k].verdict == kind:
                t = b"\x02" * 5 + u.encode()
                for i in range(5, len(t)):
                    for o in range(6):
                        c, g = t[i - o:i], t[i - o:i + 1]
                        total[c] = total.get(c, 0) + 1
                        kinds[c] = kinds.get(c, 0) + (g not in grams)
                        grams[g] = grams.get(g, 0) + 1
        assert len(grams) > 100_000  # against 2**18 slots for both before
        models[kind] = grams, total, kinds
    for k, u in rows[::37] + rows[-3:]:
        t, llr = b"\x02" * 5 + u.encode(), 0.0
        for i in range(5, len(t)):
            for sign, kind in ((1, "allow"), (-1, "block")):
                grams, total, kinds = models[kind]
                p = 1 / 256
                for o in range(6):
                    n, t_ = total.get(t[i - o:i], 0), kinds.get(t[i - o:i], 0)
                    p = (grams.get(t[i - o:i + 1], 0) + (t_ + 0.01) * p) / (n + t_ + 0.01)
                llr += sign * np.log(p)
        assert np.isclose(got[k].llr, llr / max(len(t) - 5, 1), atol=1e-8)
    assert got[6000].llr == got[6001].llr


def test_urls_of_odd_tables(spark):
    schema = "page_id long, url string"
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://x.org/a"), (1, "http://x.org/a"), (None, None), (2, "http://x.org/" + "a" * 100_000)]
    got = urls.judge(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"} and {r.cut for r in got} == {0.0}


def words(t):
    import re
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))


def brute_whole_leaks(docs, items, threshold=0.5, overlap=0.5):
    """Every passage against every item; question and answer of an item are whole, whatever its entries."""
    whole, entries = [], []
    for item, t in items:
        q, a = (words(x) for x in decontam.split_item(t or ""))
        w = q + a
        whole.append((item, q if len(w) >= 5 else w, a if len(w) >= 5 else []))
        entries += [(len(whole) - 1, w[i:i + 64]) for i in sorted({*range(0, max(len(w) - 63, 1), 64), max(len(w) - 64, 0)}) if w]
    n, mean = len(entries), np.mean([len(e) for _, e in entries])
    df = {}
    for _, w in entries:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = set()
    for doc, text in docs:
        w = words(text)
        hit = {}
        for s in range(0, max(len(w), 1), 64):
            p = w[s:s + 128]
            for k, e in entries:
                weight = {t: np.log1p((n - df[t] + .5) / (df[t] + .5)) * e.count(t) * 2.2 / (e.count(t) + 1.2 * (.25 + .75 * len(e) / mean)) for t in set(e)}
                if sum(v for t, v in weight.items() if t in p) >= threshold * sum(weight.values()) - 1e-9:
                    hit.setdefault(k if len(whole[k][1] + whole[k][2]) > 64 else (k, s), []).append(p)
        for k, found in hit.items():
            item, *parts = whole[k if isinstance(k, int) else k[0]]
            shares = []
            for part in parts:
                m = min(5, len(part))
                own = {tuple(part[i:i + m]) for i in range(len(part) - m + 1)} if m else set()
                have = {tuple(p[i:i + m]) for p in found for i in range(len(p) - m + 1)} if m else set()
                shares.append(len(own & have) / len(own) if own else 1)
            if min(shares) >= overlap:
                out.add((doc, item))
    return out


def test_leaks_against_every_passage_and_item(spark, docs_of, prose):
    r = random.Random(6)
    items = [(k, ". ".join(prose(500 + 10 * k + j, r.randrange(3, 30), 300) for j in range(r.randrange(1, 5)))) for k in range(40)]
    items += [(50, "The of and"), (51, None), (52, ""), (53, "?!"), (54, prose(9, 300, 2000)), (55, items[3][1]), (3, items[3][1]), (None, prose(10, 20))]
    docs = []
    for k in range(60):
        w = prose(k, r.randrange(0, 400), 300).split()
        if k % 2:
            t = r.choice(items)[1] or ""
            cut = t.split()
            if k % 3 == 0:
                cut = [c if r.random() > 0.15 else "q" for c in cut]
            if k % 5 == 0:
                cut = cut[: len(cut) // 2]
            at = r.randrange(len(w) + 1)
            w = w[:at] + " ".join(cut).upper().replace(".", " -").split() + w[at:]
        docs.append((k, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "xx The OF, and yy"), (103, "The of or and")]
    bench = spark.createDataFrame(items, BENCH)
    want = brute_whole_leaks(docs, items)
    assert len(want) > 15 and (102, 50) in want and (103, 50) not in want
    d = docs_of(docs).selectExpr("*", "1 as item_id", "2 as words", "3 as score")
    for size in (decontam.INDEX_BYTES, 2000):  # one index, then many
        got = decontam.leaks(d, bench, index_bytes=size).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    kept = decontam.drop_leaking(d, bench)
    assert kept.columns == d.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(k for k, _ in docs if k not in {a for a, _ in want})


def test_items_of_many_words_are_verified_whole(spark, docs_of, prose):
    r = random.Random(8)
    items = []
    for n in (63, 64, 65, 66, 128, 129, 200, 700):  # the answer is the last sentence, of 10 words or of a third
        items += [(n, prose(n, n - 10) + ". " + prose(1000 + n, 10)), (1000 + n, prose(2000 + n, n - n // 3) + ". " + prose(3000 + n, n // 3))]
    items += [(9, prose(9, 3, 50)), (65, prose(77, 90) + ". " + prose(78, 20)), (None, prose(79, 140))]
    docs = []
    for k, (_, t) in enumerate(items):
        w, q = t.replace(".", "").split(), len(decontam.split_item(t)[0].split())
        fill = lambda n: prose(r.randrange(10 ** 6), n).split()
        holed = [x if r.random() > 0.1 else "q" for x in w]
        cuts = [w, w[-1:], w[-4:], w[:q], w[q:], w[:64], w[-64:], holed, w[: len(w) // 2] + fill(300) + w[len(w) // 2:], w[: q // 3] + w[q:], w[q:] + fill(200) + w[:q]]
        docs += [(100 * k + j, " ".join(fill(r.randrange(150)) + c + fill(r.randrange(150)))) for j, c in enumerate(cuts)]
    want = brute_whole_leaks(docs, items)
    for k, (item, t) in enumerate(items):
        n = len(t.split())
        assert (100 * k, item) in want  # the whole item
        if n >= 65:  # its last words, its question, or a first entry without the answer: no leak
            assert not {(100 * k + j, item) for j in (1, 2, 3, *([5] if n >= 128 else []))} & want
    bench = spark.createDataFrame(items, BENCH)
    for size in (decontam.INDEX_BYTES, 2000):
        got = decontam.leaks(docs_of(docs), bench, index_bytes=size).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    kept = {x.doc_id for x in decontam.drop_leaking(docs_of(docs), bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in want}


def test_leaks_of_odd_tables(spark, docs_of, prose):
    bench = spark.createDataFrame([(1, prose(1, 30))], BENCH)
    assert decontam.leaks(docs_of([]), bench).count() == 0
    assert decontam.leaks(docs_of([(1, prose(1, 30))]), spark.createDataFrame([], BENCH)).count() == 0
    rows = [(1, prose(1, 30))] * 2 + [(None, prose(1, 30)), (3, prose(7, 50_000) + " " + prose(1, 30) + " " + prose(8, 50_000))]
    got = decontam.leaks(docs_of(rows), bench).collect()
    assert sorted((x.doc_id or 0, x.item_id) for x in got) == [(0, 1), (1, 1), (1, 1), (3, 1)]


@pytest.mark.parametrize("text,parts", [("What is it? A thing.", ("What is it? ", "A thing.")), ("one two three four", ("one two three", "four")), ("", ("", ""))])
def test_questions_and_answers(text, parts):
    assert decontam.split_item(text) == parts


def test_url_tables_that_grow_are_not_sent_out(spark):
    """Whatever a table's size on disk, only the 65,536 grams of order 1 at most are broadcast."""
    names = [f"http://h{k % 7}.example.{'com' if k % 2 else 'net'}/{'en' if k % 3 else 'es'}/{k * k}" for k in range(300)]
    pages = spark.createDataFrame(list(enumerate(names)), "row long, url string").withColumn("kind", F.expr("case when row % 2 = 0 then 'allow' else 'block' end"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        counts = urls.count_windows(pages).localCheckpoint()
        ratios = urls.log_ratios(counts)
        scored = urls.add_score(pages.select("row", "url"), ratios.localCheckpoint())
        for df, sent in ((ratios, 1), (scored, 0)):
            assert df.count() > 0
            df.collect()  # the plan is final then
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert plan.count("BroadcastExchange") == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
