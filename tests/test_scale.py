"""The helpers that spread hot groups give the plain result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tandem.operators import distributed as d
from tandem.operators import incremental


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group."""
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.34 else rng.randrange(1, 40), rng.randrange(1000), i) for i in range(6000)]
    return spark.createDataFrame(rows, "g int, v int, id int").repartition(7)


def test_global_position_with_running_sums(skewed):
    order = [F.col("v"), F.col("id")]
    got = d.global_position(skewed, order, "pos", running={"s": F.col("v")}).select("id", "pos", "s")
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    want = skewed.select("id", F.row_number().over(w).alias("pos"), F.sum("v").over(w).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_position_and_lag_and_top_in_hot_groups(skewed):
    order = [F.col("v"), F.col("id")]
    w = Window.partitionBy("g").orderBy(*order)
    want = skewed.select("id", F.row_number().over(w).alias("p"), F.lag("v").over(w).alias("l")).collect()
    places = dict(d.position_in_group(skewed, ["g"], order, "p").select("id", "p").collect())
    before = dict(d.previous_in_group(skewed, ["g"], order, "v", "l").select("id", "l").collect())
    assert all(places[r.id] == r.p and before[r.id] == r.l for r in want)
    top = {(r.id, r["rank"]) for r in d.top_per_group(skewed, ["g"], order, 30, spread=8).collect()}
    assert top == {(r.id, r.p) for r in want if r.p <= 30}


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 80)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    got = dict(d.components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert all(got[k] == 1 for k in range(1, 80))
    assert all(got[k] == 100 for k in range(100, 161))
    assert got[300] == got[301] == got[302] == 300
    assert len(got) == 79 + 61 + 3


def test_random_components(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = dict(d.components(spark.createDataFrame(edges, "a int, b int")).collect())
    touched = {v for a, b in edges if a != b for v in (a, b)}
    assert set(got) == touched and all(got[v] == find(v) for v in touched)


def test_chains_and_cycles_of_redirects(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q"), ("q", "p")]
    got = dict(d.follow_chains(spark.createDataFrame(links, "s string, d string"), "s", "d").collect())
    assert got == {"a": "d", "b": "d", "c": "d", "x": "y"}
    # an odd cycle, what leads to it, and a long chain beside it
    links = [("p", "q"), ("q", "r"), ("r", "p"), ("s", "p")] + [(f"n{i}", f"n{i + 1}") for i in range(37)]
    got = dict(d.follow_chains(spark.createDataFrame(links, "s string, d string"), "s", "d").collect())
    assert got == {f"n{i}": "n37" for i in range(37)}


def test_one_row_per_key(spark):
    rows = [(1, 5, "a"), (1, 7, "b"), (1, 7, "b"), (2, None, "c"), (2, -3, "d"), (None, 1, "e")]
    df = spark.createDataFrame(rows, "k int, n int, v string")
    assert sorted(map(tuple, d.one_per_key(df, ["k"], F.col("n")).collect()), key=str) == [(1, 7, "b"), (2, -3, "d"), (None, 1, "e")]
    assert sorted(r.v for r in d.one_per_key(df, ["k"], F.coalesce("n", F.lit(-9)), largest=False).collect()) == ["a", "c", "e"]


def test_order_numbers_sort_like_pairs(spark):
    edges = [-(2**62) // 10**4, -1, 0, 1, 10**17]
    pairs = [(a, b) for a in edges for b in (-(2**63), -1, 0, 2**63 - 1)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("n", d.order_number(F.col("a"), F.col("b")))
    assert [(r.a, r.b) for r in sorted(df.collect(), key=lambda r: r.n)] == sorted(pairs)


def test_rate_limit_of_hot_readers_matches_the_plain_rule(spark):
    rng = random.Random(3)
    start = datetime(2026, 1, 1)
    votes = []
    for reader, n, hours in ((1, 900, 140), (2, 60, 300), (3, 200, 30), (4, 3, 10)):
        for _ in range(n):
            votes.append((len(votes), reader, start + timedelta(seconds=rng.randrange(hours * 3600))))
    table = spark.createDataFrame(votes, "id bigint, user_id bigint, creada_en timestamp")
    want = {}
    for reader in (1, 2, 3, 4):
        own = sorted((t, i) for i, u, t in votes if u == reader)
        kept = []
        for t, i in own:
            kept = [k for k in kept if k > t - timedelta(hours=24)]
            want[i] = len(kept) < 10
            if want[i]:
                kept.append(t)
    got = {r.id: r.aceptado for r in incremental.rate_limit(table, 10).collect()}
    assert got == want


def test_rate_limit_of_a_reader_with_a_third_of_the_votes(spark):
    """The hot reader's votes are spread over all moments; the others have calm days between busy ones."""
    rng = random.Random(5)
    start = datetime(2026, 1, 1)
    votes = [(1, start + timedelta(seconds=rng.randrange(20 * 86400))) for _ in range(3000)]
    votes += [(2 + i % 200, start + timedelta(days=rng.choice([0, 1, 3, 4, 9]), seconds=rng.randrange(86400))) for i in range(6000)]
    rows = [(i, u, t) for i, (u, t) in enumerate(votes)]
    want, kept = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [k for k in kept.get(u, []) if k > t - timedelta(hours=24)]
        want[i] = len(own) < 3
        kept[u] = own + [t] if want[i] else own
    table = spark.createDataFrame(rows, "id bigint, user_id bigint, creada_en timestamp").repartition(7)
    assert {r.id: r.aceptado for r in incremental.rate_limit(table, 3).collect()} == want
    assert incremental.rate_limit(table.limit(0), 3).count() == 0


def test_sessions_across_hours(spark):
    at = lambda text: datetime.fromisoformat(f"2026-01-01T{text}")
    rows = [(1, at("10:50:00"), 1), (1, at("11:10:00"), 2), (1, at("11:39:59"), 2), (1, at("12:10:00"), 3), (2, at("10:00:00"), 1)]
    got = incremental.reading_sessions(spark.createDataFrame(rows, "user_id int, ts timestamp, capitulo int"))
    found = sorted((r.user_id, r.inicio, r.ultima, r.n, r.capitulos) for r in got.collect())
    assert found == [
        (1, at("10:50:00"), at("11:39:59"), 3, [1, 2]), (1, at("12:10:00"), at("12:10:00"), 1, [3]),
        (2, at("10:00:00"), at("10:00:00"), 1, [1]),
    ]


def _many_votes(seed, span, n):
    rng = random.Random(seed)
    # readers 1 and 2 are busy all the time, in bursts at one moment and spread; others are not
    votes = []
    for i in range(n):
        user = rng.choice([1, 1, 1, 2, rng.randrange(3, 40)])
        at = rng.randrange(span * 86_400) if user != 2 else rng.choice([0, 3, 7]) * 7000 + 86_400 * rng.randrange(span)
        votes.append((i, user, at * 1_000_000 + rng.choice([0, 0, 1])))
    return votes


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_very_long_runs_are_decided_day_by_day(spark, limit):
    """Thinned votes give the answer of the plain rule, whatever the number of votes that counts as very long."""
    votes = _many_votes(limit, 6, 900)
    want = {}
    for user in {u for _, u, _ in votes}:
        own = sorted((t, i) for i, u, t in votes if u == user)
        want |= dict(zip((i for _, i in own), incremental.accept_in_order([t for t, _ in own], limit)))
    table = spark.createDataFrame(votes, "id bigint, user_id bigint, t bigint").withColumn("creada_en", F.timestamp_micros("t"))
    for hot in (0, 200, 10**6):
        assert {r.id: r.aceptado for r in incremental.rate_limit(table, limit, hot=hot).collect()} == want, hot


def test_long_runs_with_votes_accepted_earlier(spark):
    votes, limit = _many_votes(8, 4, 300), 3
    votes = [(2**60 + i, u, t) for i, u, t in votes]  # numbers that doubles cannot tell apart
    given = [(u, t + 500_000) for i, u, t in votes[:60:3]]
    want = {}
    for user in {u for _, u, _ in votes}:
        recent = []
        for t, kind, i in sorted([(t, 0, None) for u, t in given if u == user] + [(t, 1, i) for i, u, t in votes if u == user]):
            ok = not kind or sum(1 for r in recent if r > t - 86_400_000_000) < limit
            recent += [t] if ok else []
            if kind:
                want[i] = ok
    at = F.timestamp_micros("t").alias("creada_en")
    table = spark.createDataFrame(votes, "id bigint, user_id bigint, t bigint").select("id", "user_id", at)
    before = spark.createDataFrame(given, "user_id bigint, t bigint").select("user_id", at)
    for hot in (0, 10**6):
        assert {r.id: r.aceptado for r in incremental.rate_limit(table, limit, before, hot=hot).collect()} == want, hot


def test_a_hot_reader_is_thinned_by_many_tasks(spark):
    """Of a reader's 40,000 votes of a day, the ordered pass sees a few; no task of the thinning sees most of them."""
    limit, day = 3, 86_400_000_000
    recent = F.array(*[F.lit(i * 8 * 3_600_000_000) for i in range(3)])
    votes = spark.range(40_000).select(
        F.lit(1).cast("bigint").alias("user_id"), F.lit(0).cast("bigint").alias("_run"), F.lit(1).cast("bigint").alias("_day"),
        (F.lit(day) + F.pmod(F.xxhash64("id"), F.lit(day))).alias("_t"), "id", F.lit(False).alias("_sure"), recent.alias("_recent"))
    assert incremental._thinned(votes, limit).count() <= limit * (limit + 1)
    salted = votes.withColumn("_salt", F.pmod(F.xxhash64(*votes.columns), F.lit(64)))
    sizes = [r["count"] for r in salted.groupBy("_salt").count().collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2] and len(sizes) == 64


@pytest.mark.parametrize("combined", [10, 2, 0])
def test_related_works_with_a_genre_of_a_third_of_them(spark, monkeypatch, combined):
    """Lists of combinations, and comparison genre by genre, give the brute-force order."""
    from tandem.operators import ranking

    monkeypatch.setattr(ranking, "COMBINED", combined)
    rng, k = random.Random(combined), 4
    genres = [f"g{i}" for i in range(12)]
    works = []
    for i in range(260):
        own = rng.sample(genres[1:], rng.choice([0, 1, 2, 3, 5])) + (["g0"] if rng.random() < 0.34 else [])
        works.append((i, f"t{i:03}", rng.random() < 0.1, own + own[:1], "A" if rng.random() < 0.3 else "B"))
    df = spark.createDataFrame([w[:4] for w in works], "work_id bigint, titulo string, adulta boolean, categorias array<string>")
    levels = spark.createDataFrame([(w[0], w[4]) for w in works], "work_id bigint, nivel string")
    got = {}
    for r in ranking.related_works(df, levels, k).where("origen = 'genero'").collect():
        got.setdefault(r.work_id, {})[r.puesto] = r.otra
    want = {}
    for i, _, _, own, _ in works:
        shared = [(level != "A", -len(set(own) & set(theirs)), j) for j, _, adult, theirs, level in works if j != i and not adult and set(own) & set(theirs)]
        if shared:
            want[i] = {n + 1: j for n, (_, _, j) in enumerate(sorted(shared)[:k])}
    assert got == want


def test_components_kept_current_equal_a_full_run(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(80)] + [(500, 500)]
    members, roots = spark.createDataFrame([], "node bigint, grupo bigint"), spark.createDataFrame([], "grupo bigint, root bigint")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for batch in range(4):
        part = edges[batch::4]
        new, changed = d.grow_components(members, roots, spark.createDataFrame(part, "a bigint, b bigint"))
        members, roots = d.cut_lineage(members.unionByName(new)), d.cut_lineage(d.put_in_place(roots, changed, "grupo"))
        for a, b in part:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
        if batch in (1, 3):
            got = {r.node: r.root for r in members.join(roots, "grupo").collect()}
            assert got == {n: find(n) for n in parent}
    assert members.count() == len(parent) and roots.select("grupo").distinct().count() == roots.count()


def test_a_large_group_changes_by_one_row(spark):
    chain = spark.range(12, 61).selectExpr("id AS a", "11L AS b")
    members, roots = spark.createDataFrame([], "node bigint, grupo bigint"), spark.createDataFrame([], "grupo bigint, root bigint")
    new, changed = d.grow_components(members, roots, chain)
    members, roots = d.cut_lineage(new), d.cut_lineage(changed)
    assert members.count() == 50 and [tuple(r) for r in roots.collect()] == [(11, 11)]
    new, changed = d.grow_components(members, roots, spark.createDataFrame([(30, 3)], "a bigint, b bigint"))
    assert [tuple(r) for r in new.collect()] == [(3, 3)] and sorted(map(tuple, changed.collect())) == [(3, 3), (11, 3)]


def _one_task_works(spark):
    rows = [(i, f"Alpha beta gamma delta word{i}", [f"Otro nombre largo numero {i}"], "manhwa", "", f"w-{i}") for i in range(60)]
    schema = "work_id bigint, titulo string, titulos_alternativos array<string>, tipo string, estado string, slug string"
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_titles_of_one_file_are_read_by_all_tasks(spark):
    from tandem.operators import work_pages

    chapters = spark.createDataFrame(
        [(1, 3, 7, "manhwa", "es", 5, "https://h.test/1")],
        "id bigint, work_id bigint, source_id bigint, tipo string, idioma string, numero int, url string")
    sources = spark.createDataFrame([(7, "Uno")], "source_id bigint, nombre string")
    found = work_pages.page_meta(_one_task_works(spark), chapters, sources)
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 60


def test_names_of_the_works_are_prepared_once(spark, monkeypatch):
    from tandem.operators import matching

    made = []
    real = matching.title_sets
    monkeypatch.setattr(matching, "title_sets", lambda names, *a, **k: made.append(names.rdd.getNumPartitions()) or real(names, *a, **k))
    series = spark.createDataFrame(
        [(1, 1, "u1", "x", "Gamma delta beta alpha word5", None, ["x"], False), (2, 1, "u2", "Alpha beta gamma delta word7", None, None, ["Alpha beta gamma delta word7"], False)],
        "serie_id bigint, sitio_id int, url string, titulo string, titulo_es string, slug_base string, nombres array<string>, solo_match boolean")
    bound = spark.createDataFrame([], "sitio_id int, url string, work_id bigint")
    gone = spark.createDataFrame([], "slug string")
    rows = matching.resolve_series(series, _one_task_works(spark), bound, gone, similar=True).collect()
    assert sorted((r.serie_id, r.slug, r.via) for r in rows) == [(1, "w-5", "traducido"), (2, "w-7", "nombre")]
    assert len(made) == 1 and made[0] > 1
