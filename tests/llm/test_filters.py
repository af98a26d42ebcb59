"""Quality rules, licenses, contamination, toxicity and url rules on odd rows."""

import re

import pytest

from odd_rows import no_docs, odd_docs  # noqa: F401
from sluice.llm import contamination, licenses, quality, toxicity, url_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def key(rows):
    return sorted(map(str, rows))


def test_quality_counts(odd_docs, no_docs):
    rows = quality.judged(odd_docs).selectExpr("doc_id", "text", "_quality.*", "score", "shard").collect()
    assert len(rows) == odd_docs.count() and quality.judged(no_docs).count() == 0
    for r in rows:
        text = r["text"] or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
        inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else set()
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(found), sum(map(len, found)), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        if len(grams) < 2000:
            assert r["n_repeat_words"] == len(inside)
        assert r["base_failed"] == (len(found) < 50 or 100 * r["n_repeat_words"] > 50 * len(found))


def test_frequent_lines_are_removed_and_copies_count_once(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Menu  Home\n{body} {i}", "a") for i in range(30)] + [(100 + i, f"unique copy\n{body} same", "a") for i in range(30)]
    rows += [(200 + i, f"menu home\n{'short ' * 3}{i}", "b") for i in range(30)]
    out = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert out[3]["_left"] == f"{body} 3" and out[3]["_quality"]["kept"]
    assert "unique copy" in (out[105]["_left"] or out[105]["text"]) and out[105]["_quality"]["kept"]
    assert not out[201]["_quality"]["kept"]


def test_license_index_finds_all_containments(spark, odd_docs, no_docs):
    templates = {"t1": "alpha beta gamma delta epsilon", "t2": "one two three four five six seven eight nine ten", "t3": "beta gamma zeta"}
    texts = ["alpha beta gamma delta x y", "ALPHA beta, gamma", "one two three four five six seven eight\nmore\n\nalpha beta gamma delta", "zeta beta gamma beta", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for index_words in (licenses.INDEX_WORDS, 6):
        rows = licenses.scan(docs, templates=templates, labels={"t3": "three"}, index_words=index_words).collect()
        for r in rows:
            wanted = set()
            for b, block in enumerate(re.split(r"\n\s*\n", texts[r["doc_id"]])):
                for name, template in templates.items():
                    held = set(words(template))
                    if len(held & set(words(block))) >= 0.8 * len(held):
                        wanted.add((name.replace("t3", "three"), b))
            assert {(f["label"], f["block"]) for f in r["found"]} == wanted
    for r in licenses.scan(odd_docs).join(odd_docs.select("doc_id", "text"), "doc_id").collect():
        found = words(r["text"])
        places = [i for p in licenses.PHRASES for i in range(len(found)) if found[i:i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(found), len(places), min(places, default=None), max(places, default=None))
    assert licenses.scan(no_docs).count() == 0


def test_names_of_other_columns_may_clash(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Menu Home\n{body} {i}", "a", i, "l", [1], "s", "left", "q", "x", "y") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, _host int, _line string, _lines array<int>, _stats string, _left string, _quality string, _hits string, _each string")
    out = quality.judged(docs).filter("doc_id = 3").first()
    assert out["_left"] == f"{body} 3" and out["_quality"]["kept"]
    assert (out["_host"], out["_line"], out["_lines"], out["_stats"], out["_hits"]) == (3, "l", [1], "s", "x")
    bench = spark.createDataFrame([(1, " ".join(body.split()[5:20]))], "item_id long, text string")
    hit = contamination.with_hits(docs, bench).filter("doc_id = 3").first()
    assert hit["_hits"]["items"] == [1] and hit["_each"] == "y" and hit["_host"] == 3


@pytest.mark.parametrize("max_words, max_bytes", [(contamination.MAX_WORDS, contamination.MAX_BYTES), (20, contamination.MAX_BYTES), (20, 50)])
def test_contamination(spark, odd_docs, no_docs, max_words, max_bytes):
    texts = [r["text"] for r in odd_docs.orderBy("doc_id").collect()]
    long = next(t for t in texts if t and len(t.split()) == 9000).split()
    items = [(1, " ".join(long[50:70]).upper()), (2, "two WORDS"), (3, None), (4, "!!"), (None, " ".join(long[8000:8011])), (1, "license under the general"), (5, "absent")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination.with_hits(odd_docs, bench, max_words=max_words, max_bytes=max_bytes).collect()
    for r in rows:
        found, hit, ids = words(r["text"]), set(), set()
        for item, text in items:
            w = words(text)
            for n in {min(10, len(w))} if w else ():
                for a in range(len(w) - n + 1):
                    for i in range(len(found) - n + 1):
                        if found[i:i + n] == w[a:a + n]:
                            hit |= set(range(i, i + n))
                            ids.add(item)
        got = {i for a, b in r["_hits"]["spans"] for i in range(a, b)}
        assert (r["_hits"]["n_words"], got, set(r["_hits"]["items"])) == (len(found), hit, ids - {None})
        for (a, b), (x, y) in zip(r["_hits"]["spans"], r["_hits"]["offsets"]):
            assert words((r["text"] or "").encode()[x:y].decode()) == found[a:b]
    assert contamination.with_hits(no_docs, bench).count() == 0
    assert contamination.with_hits(odd_docs, bench.limit(0)).filter("size(_hits.spans) > 0").count() == 0


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://net/", "HTTP://A.NET", "http://a.net/x", "https://Example.net/en/1?q#f", "http://x.y.example.net/en/", "http://example.net/e",
            "http://badexample.com/de/", "http://www.example.com/de/?", "http://org/fr/", "http://a.org/de/", "http://evil.net:80/", "http://a.net/x", "://", "http:///net/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, "http://a.net/x", "x", "y")], "page_id long, url string, host string, rule string")
    rules = url_rules.RULES + [("example.net", "/en/1", "block"), ("x.y.example.net", "/", "block"), ("net", "/", "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for part_keys in (url_rules.PART_KEYS, 1):
        for r in url_rules.judge(pages, table, part_keys=part_keys).collect():
            url = "http://a.net/x" if r["page_id"] is None else urls[r["page_id"]]
            rest = (url or "").partition("://")[2]
            host = re.match(r"[^/?#]*", rest)[0].translate(AZ)
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
            fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fit, default=None)
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best[3], best[2] if best else "allow"), url
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, table.limit(0), default="block").collect()} == {"block"}


def test_toxicity_learns_words_and_characters(spark, odd_docs, no_docs):
    import random

    rng = random.Random(1)
    syllables = ["an", "er", "the", "in", "re", "on", "st", "ly", "ou", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        text = [word() for _ in range(rng.randint(5, 120))]
        if i % 3 == 0:
            for _ in range(1 + len(text) // 20):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "brute", "zogg" + word()]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.filter("doc_id < 450"))
    scores = docs.filter("doc_id >= 450").withColumn("s", toxicity.score(model)).collect()
    right = sum((r["s"] >= toxicity.LIMIT) == (r["doc_id"] % 3 == 0) for r in scores)
    assert right >= 0.95 * len(scores)
    odd = odd_docs.withColumn("s", toxicity.score(model)).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["s"] <= 1 for r in odd)
    assert all(r["s"] == 0 for r in odd if not words(r["text"]))
    assert no_docs.withColumn("s", toxicity.score(model)).count() == 0
    assert toxicity.fit(docs, marks.filter("toxic = 0")) is None
