"""URL rules, decontamination, quality rules and mixing."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from hourmark.llm import decontaminate, mixing, quality, urlrules
from hourmark.llm.words import ascii_lower
from tests.llm import brute, cases
from tests.llm.cases import frame, ordered, rows_of

URLS = [
    "https://www.Example.com/en/1", "http://example.com/en/", "http://example.com/fr/1?x=/en/", "https://a.b.net/es/x#y",
    "http://net/fr/", "http://net/de/", "http://notexample.com/en/2", "https://x.www.example.com/en/q", "ftp://example.com", "http://com/",
    "HTTP://EXAMPLE.COM/EN/", "no scheme", "", None, "://", "a://b://c/d", "http:///en/", "http://.com/", "http://example.com./en/",
    "http://ex\u00c4mple.com/\u00e4?q", "http://user@www.example.com:80/en/", "https://a.example.com?/en/", "http://com.example/", "https://www.example.com/en/" + "z" * 5000,
]


def pages(spark, extra=()):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, URLS[1], "")]
    return rows, frame(spark, rows, "page_id bigint, url string, html string", extra)


def rules(spark, listed=brute.RULES):
    return spark.createDataFrame(listed, "host string, path string, verdict string")


def test_urls_like_brute_force(spark):
    rows, df = pages(spark, ["host", "path", "rule", "verdict", "top", "level", "range"])
    got = urlrules.judge(df, rules(spark))
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == ordered([(i, *brute.url(u)) for i, u, _ in rows])


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_nested_rules_over_any_number_of_ranges(spark, ranges):
    listed = [("com", "", "block"), ("com", "/a", "allow"), ("com", "/ab", "block"), ("x.com", "/a", "block"), ("x.com", "/a/b", "allow"), ("b.x.com", "", "allow")]
    urls = [f"http://{h}/{p}" for h in ("com", "x.com", "a.x.com", "b.x.com", "xx.com", "c.b.x.com") for p in ("", "a", "ab", "a/b", "abc", "b", "a/bc")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    split = df.select(urlrules.host_of(F.col("url")).alias("host"), urlrules.path_of(F.col("url")).alias("path"))
    got = {(r.host, r.path): (r.rule, r.verdict) for r in urlrules.match(split, rules(spark, listed), ranges).collect()}
    for u in urls:
        host, path, rule, verdict = brute.url(u, listed)
        assert got.get((host, path), (None, "allow")) == (rule, verdict)


def test_equal_rules_block_and_bad_rules_are_ignored(spark):
    listed = [("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("net", None, "block")]
    df = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.net"), (3, "http://c.org/")], "page_id bigint, url string")
    assert rows_of(urlrules.judge(df, rules(spark, listed)), "page_id", "rule", "verdict") == [(1, "com/", "block"), (2, "net", "block"), (3, None, "allow")]


def test_urls_empty(spark):
    _, df = pages(spark)
    assert urlrules.judge(df.limit(0), rules(spark)).count() == 0
    assert {r.verdict for r in urlrules.judge(df, rules(spark, [])).collect()} == {"allow"}


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "Short item, three"), (10, "ÉTÉ été 1 2 3 4 5 6 7 8 9"),
         (None, "nameless item of four"), (3, None), (4, " ... "), (2, "another two words"), (5, "one two one two one two one two one two one")]
SUSPECTS = ["x ALPHA-beta gamma, delta epsilon zeta eta theta iota kappa lambda y", "a short ITEM three short item three", "beta gamma delta epsilon zeta eta theta iota kappa lambda",
            "alpha beta gamma delta epsilon zeta eta theta iota", "ÉTÉ été 1 2 3 4 5 6 7 8", "nameless item of four!", None, "", "one two " * 40, "another two words short item three"]


def test_contamination_like_brute_force(spark):
    docs = [(i, t, None, None, None) for i, t in enumerate(SUSPECTS)] + cases.documents() + [(1, SUSPECTS[1], None, None, None)]
    items = frame(spark, ITEMS, "item_id bigint, text string", ["gram", "hash"])
    got = decontaminate.judge(frame(spark, docs, cases.DOCS, cases.CLASHING), items)
    want = ordered([(d[0], *brute.contamination(d[1], ITEMS)) for d in docs])
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_contaminated_documents_or_spans_go(spark):
    docs = frame(spark, [(i, t, None, "s", 1) for i, t in enumerate(SUSPECTS)], cases.DOCS, cases.CLASHING)
    items = frame(spark, ITEMS, "item_id bigint, text string")
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(i,) for i, t in enumerate(SUSPECTS) if not brute.contamination(t, ITEMS)[4]]
    cut = dict(rows_of(decontaminate.clean(docs, items, remove="spans"), "doc_id", "text"))
    assert cut[0] == "x  y" and cut[1] == "a " and cut[6] is None and cut[3] == SUSPECTS[3]
    assert all(not brute.contamination(t, ITEMS)[4] for t in cut.values())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


VARIED = [(n, " ".join(f"w{(n * 7 + k) % 23}" for k in range(n))) for n in range(3, 14)]


def test_words_are_the_contracts_at_every_edge(spark):
    edges = [*range(0x100), 0x17F, 0x212A, 0xFFFD, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    texts = [(k, f"ab{chr(k)}Cd {chr(k)}") for k in edges]
    got = spark.createDataFrame(texts, "doc_id bigint, text string").select("doc_id", decontaminate._words(F.col("text")).alias("words"))
    assert {r.doc_id: r.words for r in got.collect()} == {k: brute.BENCH_WORD.findall(t.translate(brute.UPPER)) for k, t in texts}


def test_words_are_matched_as_fast_as_they_are_split(spark):
    docs = spark.range(8000).repartition(8).select(F.repeat(F.lit("some words of a text, and more of them. "), 100).alias("text")).cache()
    docs.count()

    def seconds(words):
        started = time.perf_counter()
        assert docs.agg(F.sum(F.size(words))).first()[0] >= 8000 * 900
        return time.perf_counter() - started

    split = F.split(ascii_lower(F.col("text")), r"[\x00-/:-`{-\x7F]+", -1)
    seconds(split), seconds(decontaminate._words(F.col("text")))
    # the class by the characters that it is not takes ten times as long
    assert min(seconds(decontaminate._words(F.col("text"))) for _ in range(3)) < 4 * min(seconds(split) for _ in range(3))


@pytest.mark.parametrize("bound", [0, decontaminate.BROADCAST_BYTES])
def test_items_of_many_lengths_and_a_table_too_large_to_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    rng = random.Random(8)
    docs = [(i, " ".join(f"W{rng.randrange(23) if rng.random() < 0.1 else (i + k) % 23}" for k in range(rng.choice([0, 1, 5, 40, 400]))), None, None, None) for i in range(60)]
    docs += docs[:3] + [(None, docs[4][1], None, None, None), (70, None, None, None, None)]
    items = frame(spark, VARIED + ITEMS, "item_id bigint, text string")
    got = decontaminate.judge(frame(spark, docs, cases.DOCS), items)
    want = ordered([(d[0], *brute.contamination(d[1], VARIED + ITEMS)) for d in docs])
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_plan_of_the_probes(spark, monkeypatch, tmp_path):
    frame(spark, cases.documents(), cases.DOCS).write.parquet(str(tmp_path / "d"))
    docs, items = spark.read.parquet(str(tmp_path / "d")), frame(spark, VARIED, "item_id bigint, text string")
    near = plan_of(decontaminate.find_hits(docs, items)).split("== Initial Plan ==")[0]
    assert near.count("FileScan parquet") == 1 and near.count("Generate posexplode") == 1
    (join,) = [line for line in near.split("\n") if "BroadcastHashJoin" in line]
    keys, condition = join.split("Inner")
    assert "slice" not in keys and "slice" in condition
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(conf, "-1")
    try:
        far = plan_of(decontaminate.find_hits(docs, items)).split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset(conf)
    joins = [line for line in far.split("\n") if "SortMergeJoin" in line]
    assert len(joins) == 2 and all("slice" not in line.split("Inner")[0] for line in joins)
    # words travel with the key of their text, never with the windows
    exchanges = [line for line in far.split("\n") if "Exchange hashpartitioning" in line]
    assert any("hashpartitioning(hash" in line for line in exchanges) and not any("slice" in line or "words" in line for line in exchanges)


def test_contamination_empty(spark):
    docs, items = frame(spark, [(1, "a b", None, None, None)], cases.DOCS), frame(spark, ITEMS, "item_id bigint, text string")
    assert decontaminate.judge(docs.limit(0), items).count() == 0
    assert rows_of(decontaminate.judge(docs, items.limit(0)), "n_words", "n_hit", "contaminated") == [(2, 0, False)]
    assert decontaminate.clean(docs, items.limit(0)).count() == 1


def labels(spark):
    rows = [(i, 1, 0) for i in range(30)] + [(31, 0, 0), (32, 1, 1), (None, 1, 0), (3, 1, None), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_base_counts_like_brute_force(spark):
    docs = cases.documents()
    got = quality.judge(frame(spark, docs, cases.DOCS, [*cases.CLASHING, "trusted", "m"]), labels(spark))
    want = ordered([(d[0], *brute.quality(d[1])) for d in docs])
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want


def test_score_is_the_mean_log_ratio(spark):
    docs = frame(spark, [(1, "a b a"), (2, "c"), (3, None)], "doc_id bigint, text string")
    trusted = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    n = 64
    grams = {1: [[w] for w in "aba"] + [["a", "b"], ["b", "a"]], 2: [["c"]]}
    hashed = spark.range(1)
    one = {w: hashed.select(F.xxhash64(F.lit(w))).first()[0] for w in "abc"}
    two = {p: hashed.select(F.xxhash64(F.lit(one[p[0]]), F.lit(one[p[1]]))).first()[0] for p in ("ab", "ba")}
    bucket = {i: [(one[g[0]] if len(g) == 1 else two["".join(g)]) % n for g in gs] for i, gs in grams.items()}
    raw = [sum(b == k for bs in bucket.values() for b in bs) for k in range(n)]
    good = [bucket[1].count(k) for k in range(n)]
    ratio = [math.log((good[k] + 1) / (sum(good) + n)) - math.log((raw[k] + 1) / (sum(raw) + n)) for k in range(n)]
    want = [(i, round(sum(ratio[b] for b in bucket[i]) / len(bucket[i]), 9)) for i in (1, 2)] + [(3, 0.0)]
    assert [(i, round(s, 9)) for i, s in rows_of(quality.judge(docs, trusted, buckets=n), "doc_id", "score")] == want


def test_junk_goes_and_columns_stay(spark):
    junk = [(900 + n, " ".join(f"zq{k}%%% ##{k}" for k in range(n, n + 60)), None, None, None) for n in range(40)]
    docs = [d for d in cases.documents() if len(d[1] or "") < 5000] + junk
    df = frame(spark, docs, cases.DOCS, cases.CLASHING)
    kept = quality.keep(df, labels(spark))
    assert kept.columns == df.columns
    ids = {i for (i,) in rows_of(kept, "doc_id")}
    assert not {900 + n for n in range(40)} & ids
    assert set(range(30)) - {3} <= ids  # several copies of 3 have no label
    again = quality.judge(df, labels(spark)).where("kept")
    assert rows_of(again, "doc_id") == rows_of(kept, "doc_id")


def test_quality_without_labels_or_documents(spark):
    df = frame(spark, cases.documents(), cases.DOCS)
    assert rows_of(quality.judge(df, labels(spark).limit(0)).where("kept = base_failed"), "doc_id") == []
    assert quality.judge(df.limit(0), labels(spark)).count() == 0


def mixed(spark, docs, extra=()):
    return mixing.mix(frame(spark, docs, cases.DOCS, extra), block_words=16)


def test_mix_meets_its_targets(spark):
    docs = cases.documents()
    got = mixed(spark, docs, [*cases.CLASHING, "target", "mark", "piece"]).collect()
    sizes = {}
    for _, text, _, source, _ in docs:
        sizes[source] = sizes.get(source, 0) + len(brute.BLANK_WORD.findall(text or ""))
    want = brute.targets(sizes)
    assert len(got) == len(docs)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 16 + 0.01 * want[source]


def test_blocks_hold_what_the_mix_takes(spark):
    docs = [d for d in cases.documents() if d[0] not in (None, 12)]
    df = frame(spark, docs, cases.DOCS).dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mixing.mix(df, block_words=16).collect() if r.taken}
    held, slots = {}, {}
    for r in mixing.mixed_blocks(df, block_words=16).collect():
        assert 0 <= r.first < r.after
        held[r.doc_id] = held.get(r.doc_id, 0) + r.after - r.first
        slots.setdefault(r.slot, []).append((r.source, r.after - r.first))
    assert held == taken
    assert all(len({s for s, _ in rows}) == 1 and 1 <= sum(n for _, n in rows) <= 24 for rows in slots.values())


def small_sources():
    rng = random.Random(4)
    docs = [(k, cases.prose(rng, rng.randint(6, 14)), None, f"s{k:03}", None) for k in range(200)]
    docs += [(900 + k, cases.prose(rng, 300), None, ["big", None][k % 2], None) for k in range(20)]
    docs += [(None, cases.prose(rng, 9), None, "s001", None) for _ in range(50)] + [(7, cases.prose(rng, 5), None, "s007", None) for _ in range(20)]
    return docs + docs[:10]


@pytest.mark.parametrize("made", [cases.documents, small_sources])
def test_mix_like_a_sequential_one(spark, made):
    docs = made()
    want, taken = brute.mix(docs)
    expected = ordered([(d[0], d[3], len(brute.BLANK_WORD.findall(d[1] or "")), n) for d, n in zip(docs, taken)])
    for df in (frame(spark, docs, cases.DOCS).coalesce(1), frame(spark, docs, cases.DOCS).repartition(5)):
        assert rows_of(mixing.mix(df), "doc_id", "source", "size", "taken") == expected
    sums = dict.fromkeys(want, 0)
    for d, n in zip(docs, taken):
        sums[d[3]] += n
    assert all(abs(sums[s] - want[s]) <= max(1, 0.02 * want[s]) for s in want)


def test_the_mixed_text_is_that_of_the_documents(spark):
    docs = small_sources() + cases.documents()
    df = frame(spark, docs, cases.DOCS, [*cases.CLASHING, "slot", "words", "__mark"]).repartition(3)
    texts = {}
    for d in docs:
        texts.setdefault((d[0], d[3]), []).append(brute.re.findall(r"[^ \t-\r]+[ \t-\r]*", d[1] or ""))
    rows = mixing.mixed_text(df).collect()
    assert all(r.text in {"".join(words[r["first"] : r.after]) for words in texts[r.doc_id, r.source]} for r in rows)
    assert sum(r.after - r["first"] for r in rows) == sum(brute.mix(docs)[1])
    assert all(len(brute.BLANK_WORD.findall(r.text)) == r.after - r["first"] for r in rows)
    assert mixing.mixed_text(df.limit(0)).count() == 0


def test_targets_stop_at_three_sizes(spark):
    sizes = {"a": 1, "b": 50, "c": 10, "d": 2, "e": 400, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute.targets(sizes)
    assert all(math.isclose(got[s], want[s]) for s in sizes) and got["a"] == 3.0


def test_mix_of_nothing(spark):
    df = frame(spark, [(1, None, None, "a", None), (2, "", None, None, None)], cases.DOCS)
    assert mixing.mix(df.limit(0)).count() == 0
    assert rows_of(mixing.mix(df), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_every_source_takes_its_quota(spark):
    quotas = {"big": 2_500_000, "other": 1_500_000, None: 4, **{f"s{n:03}": n % 30 + 1 for n in range(300)}}
    df = spark.createDataFrame(list(quotas.items()), "source string, quota bigint")
    slots = mixing.schedule(df).cache()
    got = slots.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("least"), F.max("rank").alias("most"))
    assert {r.source: (r.n, r.ranks, r.least, r.most) for r in got.collect()} == {s: (q, q, 0, q - 1) for s, q in quotas.items()}
    assert slots.select("slot").distinct().count() == sum(quotas.values())
    slots.unpersist()


def test_points_stay_golden_in_long_schedules(spark):
    slots = [0, 1, 2, 46_368, 4_000_000, (1 << 31) - 1, 1 << 31, (1 << 40) + 12345]
    df = spark.createDataFrame([(k,) for k in slots], "slot bigint")
    got = dict(rows_of(df.select("slot", mixing.golden_point(F.col("slot")).alias("point")), "slot", "point"))
    assert got == {k: (k * mixing.GOLDEN % (1 << 62) >> 9) / (1 << 53) for k in slots}
    # points of a long schedule leave no gap much wider than their mean distance
    made = spark.range(1_000_000).select(mixing.golden_point(F.col("id")).alias("point"))
    cells = made.groupBy(F.floor(F.col("point") * 250_000)).count().agg(F.count(F.lit(1)), F.min("count"), F.max("count")).first()
    assert cells[0] == 250_000 and cells[1] >= 2 and cells[2] <= 6
