"""Golden cases of the operators."""

import ipaddress
import json
import random
from pathlib import Path

import pytest
from eventloom.functions import markup, text, urls
from eventloom.operators import addresses, calendar, chains, dedupe, frontier, ordered, resolve
from eventloom.sources import listing, published
from eventloom.sources import pages as page_files
from pyspark.sql import functions as F

EVENT = f"ord bigint, name string, event_date string, registration_deadline string, venue string, region string, courses {text.COURSE_TYPE}, application_url string, official_site_url string, logo_url string, notes string, url_scheme string, sources array<string>, verified boolean, last_verified timestamp, registration_status string"


def events(spark, rows):
    full = [(i, r["name"], r.get("date", "2026-05-01"), r.get("deadline"), r.get("venue", "미상"), None, r.get("courses", []), r.get("url", f"https://site{i}.example.com/x"), None, None, r.get("notes"), None, [r.get("source", f"s{i}")], r.get("verified", False), None, "unknown") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def deduplicated(spark, rows):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return sorted(dedupe.deduplicated(events(spark, rows), now).collect(), key=lambda r: r.ord)


def test_variants_of_one_site_are_one_event(spark):
    rows = [{"name": "2026 서울 하프 마라톤", "venue": "서울 광장", "url": "https://run.example.com/a"}, {"name": "서울하프마라톤대회", "venue": "서울광장", "url": "https://www.run.example.com/b"}, {"name": "서울 하프", "venue": "서울 광장", "url": "https://run.example.com/a/"}]
    got = deduplicated(spark, rows)
    assert len(got) == 1 and got[0].sources == ["s0", "s1", "s2"] and got[0].region == "서울"


def test_matching_is_against_anchors_only(spark):
    edges = spark.createDataFrame([("d", 0, 1), ("d", 1, 2), ("d", 2, 3)], "event_date string, a bigint, b bigint")
    rows = spark.createDataFrame([("d", i) for i in range(4)], "event_date string, ord bigint")
    got = {r.ord: r.anchor for r in dedupe.greedy_anchors(rows, edges, "event_date").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


@pytest.mark.parametrize("seed", range(3))
def test_anchors_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    n = 150
    made = sorted({(g, *sorted(rng.sample(range(n), 2))) for g in ("d", "e") for _ in range(rng.choice([40, 200, 900]))})
    edges = spark.createDataFrame(made, "event_date string, a bigint, b bigint")
    rows = spark.createDataFrame([(g, i) for g in "de" for i in range(n)], "event_date string, ord bigint")
    want = {}
    for g in "de":
        anchors = []
        for i in range(n):
            own = next((x for x in anchors if (g, x, i) in set(made)), i)
            want[g, i] = own
            if own == i:
                anchors.append(i)
    assert {(r.event_date, r.ord): r.anchor for r in dedupe.greedy_anchors(rows, edges, "event_date").collect()} == want


def test_anchors_of_one_hot_date(spark):
    """A date of 200,000 events: each matches the four after it."""
    n = 200_000
    rows = spark.range(n).select(F.lit("d").alias("event_date"), F.col("id").alias("ord"))
    edges = rows.where("ord % 5 <> 4").select("event_date", F.col("ord").alias("a"), F.explode(F.sequence(F.col("ord") + 1, F.col("ord") - F.col("ord") % 5 + 4)).alias("b"))
    got = dedupe.greedy_anchors(rows, edges, "event_date")
    assert got.where(F.col("anchor") != F.col("ord") - F.col("ord") % 5).isEmpty() and got.count() == n


def test_pairs_of_a_hot_host_equal_all_pairs(spark):
    """One date and host: far fewer candidates than pairs, and none lost."""
    rng = random.Random(2)
    words = ["".join(rng.choice("가나다라마바사아자차카타파하강산들꽃길별달해") for _ in range(3)) for _ in range(150)]
    rows = []
    for i in range(600):
        name = " ".join(rng.sample(words, 3)) if i % 3 else f"{rows[-1]['name']}{rng.choice(['', ' 대회', ' 10K', words[0]])}" if rows else "a"
        site = rng.choice(["https://one.example.com/", "https://one.example.com/", f"https://s{i % 7}.example.com/"])
        rows.append({"name": name, "venue": rng.choice(["미상", "서울 광장", "서울광장 앞", rng.choice(words), "", "x"]), "url": site + rng.choice(["", "race/1", "race/2", f"e/{i}"])})
    frame = dedupe.profiled(events(spark, rows)).select("event_date", "ord", "p").cache()
    left, right = (frame.select("event_date", F.col("ord").alias(k), F.col("p").alias(f"p{k}")) for k in "ab")
    want = {(r.a, r.b) for r in left.join(right, "event_date").where("a < b").where(dedupe.same_event(F.col("pa"), F.col("pb"))).collect()}
    assert {(r.a, r.b) for r in dedupe.pairs(frame).collect()} == want and len(want) > 50
    share = dedupe.candidates(frame).count() / (600 * 599 / 2)
    assert share < 0.25, share


def test_junk_goes_and_markup_is_scrubbed(spark):
    got = deduplicated(spark, [{"name": "마라톤 대회"}, {"name": "대회 후기 모음"}, {"name": "A &amp; B Run", "venue": "<b>x</b>"}])
    assert [(r.name, r.venue) for r in got] == [("A & B Run", "미상")]


def test_aggregators_and_other_dates_stay_apart(spark):
    rows = [{"name": "가을 달리기", "venue": "부산", "url": "https://kormarathon.com/ko/race/1"}, {"name": "겨울 행진", "venue": "부산", "url": "https://kormarathon.com/ko/race/1"}, {"name": "가을 달리기", "venue": "부산", "date": "2026-05-02"}]
    assert len(deduplicated(spark, rows)) == 3


def test_merge_rules(spark):
    c = lambda n, p: (n, p, None)
    rows = [
        {"name": "한강 마라톤", "venue": "미상", "url": "https://kormarathon.com/ko/race/a", "courses": [c("10K", None)], "notes": "x", "source": "a"},
        {"name": "한강 마라톤", "venue": "미상", "url": "https://han.example.com/e", "deadline": "2026-04-01", "courses": [c("5K", 1), c("10K", 2)], "notes": "y", "verified": True, "source": "b"},
    ]
    frame = events(spark, rows).withColumn("anchor", F.lit(0))
    got = dedupe.merged(frame, F.lit("2026-01-01 00:00:00").cast("timestamp")).first()
    assert (got.application_url, got.registration_deadline, got.notes, got.verified, got.sources) == ("https://han.example.com/e", "2026-04-01", "x; y", True, ["a", "b"])
    assert [(x.name, x.price) for x in got.courses] == [("10K", 2), ("5K", 1)]


def test_budgets(spark):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate("aaabbb")], "ord int, host string")
    got = [r.outcome for r in ordered.reserved(rows, "host", "ord", run=4, per_host=2).orderBy("ord").collect()]
    assert got == ["reserved", "reserved", "host", "reserved", "reserved", "run"]
    with_ok = rows.withColumn("ok", F.col("ord") % 2 == 1)
    assert [r.outcome for r in ordered.within_budget(with_ok, [], "ord", 2, F.col("ok")).orderBy("ord").collect()] == ["rejected", "taken", "rejected", "taken", "rejected", "skipped"]


def test_order_is_the_same_for_any_partitioning(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("ord"), (F.col("id") * 37 % 5).alias("p"))
    found = [sorted(map(tuple, ordered.best_of_each(rows.repartition(n), ["k"], "p", "ord").select("k", "ord", "p", "place").collect())) for n in (1, 8)]
    assert found[0] == found[1]


def test_calendar(spark):
    rows = spark.createDataFrame([("2026-11-01", 0), ("2027-01-05", 1), ("2026-11-30", 2)], "d string, ord int").withColumn("d", F.to_date("d"))
    assert [(r.month, r.n) for r in calendar.by_month(rows, "d", "ord").collect()] == [("2026-11", 2), ("2027-01", 1)]
    grid = {r.day: (r.cell, r.n) for r in calendar.day_grid(rows, "d", spark.createDataFrame([("2026-11",)], "month string")).collect()}
    assert len(grid) == 30 and grid[1] == (0, 1) and grid[2] == (1, 0) and grid[30] == (29, 1)


def step(url, outcome="ok", official=True, children=(), host=None, final=None):
    return {"url": url, "host": host or url, "final": final or url, "outcome": outcome, "official": official, "application": False, "children": list(children), "child_policy": 0}


STEPS = f"run_id bigint, ord bigint, chain string, kind string, steps array<{frontier.STEP}>"


def walked(spark, url, kind, steps):
    row = frontier.traversed(spark.createDataFrame([(0, 1, url, kind, list(steps))], STEPS)).first()
    return row.asDict(), row.accepted_urls


def in_order(chains, run, per_host):
    """Chains visited one after the other, with a queue, as the rules are told."""
    used, by_host, out = 0, {}, {}
    for _, chain, kind, steps in sorted(chains, key=lambda c: c[0]):
        known = {}
        for s in steps:
            known.setdefault(s["url"], s)
        n, good, seen, queue = dict.fromkeys(frontier.COUNTS, 0), [], set(), [(steps[0]["url"], True)]
        while queue:
            url, top = queue.pop(0)
            s = known.get(url) or step(url, "fetch", False)
            if url in seen or n["fetched"] == 2:
                n["cycle" if url in seen else "depth"] += 1
            elif used == run or by_host.get(s["host"], 0) == per_host:
                n["run_budget" if used == run else "host_budget"] += 1
            else:
                used, by_host[s["host"]] = used + 1, by_host.get(s["host"], 0) + 1
                n["fetched"] += 1
                if s["outcome"] in ("policy", "fetch") or s["final"] in seen:
                    n[s["outcome"] if s["outcome"] in ("policy", "fetch") else "cycle"] += 1
                    continue
                seen |= {url, s["final"]}
                if s["outcome"] == "identity":
                    n["identity"] += 1
                    continue
                look = top and (kind == "application" or not s["official"])
                if look:
                    n["policy"] += s["child_policy"]
                    n["depth"] += max(len(s["children"]) - 3, 0)
                    for child in s["children"][:3]:
                        if child in seen:
                            n["cycle"] += 1
                        else:
                            queue.append((child, False))
                if look and s["children"]:
                    continue
                if s["official"]:
                    n["accepted"] += 1
                    good.append(s["final"])
                elif not (look and s["child_policy"]):
                    n["policy"] += 1
        out[chain] = (*n.values(), good)
    return out


@pytest.mark.parametrize(("seed", "run", "per_host"), [(1, 40, 10), (2, 25, 3), (3, 60, 4), (4, None, 5), (5, 30, None), (6, None, None)])
def test_rounds_equal_walking_in_order(spark, seed, run, per_host):
    rng = random.Random(seed)
    chains = []
    for i in range(120):
        names = [f"p{i}-{k}" for k in range(5)]
        steps = []
        for name in names[: rng.randint(1, 5)]:
            final = rng.choice([name, name, name, rng.choice(names)])
            children = rng.sample([*names, "nowhere"], rng.randint(0, 5))
            made = step(name, rng.choice(["ok"] * 6 + ["identity", "fetch", "policy"]), rng.random() < 0.5, children, f"h{rng.randint(0, 9)}", final)
            steps.append(made | {"child_policy": rng.choice([0, 0, 2])})
        chains.append((rng.randint(0, 10**6) * 200 + i, names[0], rng.choice(["application", "official"]), steps))
    frame = spark.createDataFrame([(0, *c) for c in chains], STEPS)
    got = {r.chain: (*(r[k] for k in frontier.COUNTS), r.accepted_urls) for r in frontier.traversed(frame, run, per_host).collect()}
    assert got == in_order(chains, run, per_host)


def test_one_run_of_many_chains_is_not_one_task(spark):
    n = 100_000
    url = F.concat(F.lit("u"), F.col("id"))
    one = F.struct(url, F.concat(F.lit("h"), F.col("id") % 3), url, F.lit("ok"), F.lit(True), F.lit(False), F.array().cast("array<string>"), F.lit(0)).cast(frontier.STEP)
    rows = spark.range(n).select(F.lit(0).alias("run_id"), F.col("id").alias("ord"), url.alias("chain"), F.lit("official").alias("kind"), F.array(one).alias("steps"))
    found = frontier.traversed(rows, run=50_000, per_host=20_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    sums = frontier.totals(found).first()
    assert (sums.fetched, sums.run_budget, sums.host_budget) == (50_000, 50_000, 0)
    sums = frontier.totals(frontier.traversed(rows, run=None, per_host=20_000)).first()
    assert (sums.fetched, sums.host_budget) == (60_000, 40_000)


def test_four_children_fetch_one(spark):
    counts, accepted = walked(spark, "s", "application", (step("s", children="abcd"), *map(step, "abcd")))
    assert (counts["fetched"], counts["depth"], counts["accepted"], accepted) == (2, 3, 1, ["a"])


def test_budget_is_shared_in_order(spark):
    schema = f"run_id bigint, ord bigint, chain string, kind string, steps array<{frontier.STEP}>"
    rows = [(0, i, f"c{i}", "official", [step(f"u{i}", host="h")]) for i in range(4)]
    got = {r.chain: (r.accepted, r.host_budget, r.run_budget) for r in frontier.traversed(spark.createDataFrame(rows, schema), run=3, per_host=2).collect()}
    assert got == {"c0": (1, 0, 0), "c1": (1, 0, 0), "c2": (0, 1, 0), "c3": (0, 1, 0)}


def test_skips_of_walk(spark):
    counts, accepted = walked(spark, "s", "official", (step("s", official=False, children=["s", "b"]), step("b", host="s")))
    assert counts["cycle"] == 1 and accepted == ["b"]
    counts, _ = walked(spark, "x", "official", [step("x", "fetch", False)])
    assert counts["fetch"] == 1


def test_chains_take_the_earliest(spark):
    evidence = lambda t, d: (t, d, [])
    rows = [("https://a.com/x#1", "application", "s1", evidence(["B"], ["2026-06-01"]), None, 0), ("https://a.com/x", "application", "s2", evidence(["A"], ["2026-05-01"]), None, 1), ("https://a.com/login", "official", "s1", evidence(["C"], []), None, 2), ("https://b.com/", "application", "s1", evidence(["D"], ["2020-01-01"]), None, 3)]
    seeds = spark.createDataFrame(rows, f"url string, kind string, source_id string, evidence {chains.EVIDENCE}, trusted struct<source_detail_url:string,event_date:string,venue:string>, ord bigint")
    got = chains.chains(seeds, F.lit("2026-01-01")).collect()
    assert [(r.chain, r.sort_date, r.sort_name, len(r.evidence)) for r in got] == [("https://a.com/x", "2026-05-01", "A", 2)]
    assert [(r.chain, r.ord) for r in chains.ordinals(chains.chains(seeds, F.lit("2019-01-01"))).orderBy("ord").collect()] == [("https://b.com/", 1), ("https://a.com/x", 2)]


def test_trusted_details_conflict(spark):
    rows = spark.createDataFrame([([("u", "2026-01-01", "v"), ("w", "2026-01-01", None)],), ([("u", "2026-01-01", None), ("w", "2026-01-02", None)],), ([],)], "t array<struct<source_detail_url:string,event_date:string,venue:string>>")
    got = [r.c for r in rows.select(chains.trusted_of(F.col("t")).alias("c")).collect()]
    assert (got[0].conflict, got[0].detail.venue, got[1].conflict, got[2].detail) == (False, "v", True, None)


def test_logos(spark):
    kinds = [("logo", "u1", "서울하프마라톤", "2026-05-01", "서울하프마라톤"), ("image", "u2", "서울하프마라톤", "2026-05-01", "서울하프마라톤"), ("logo", "u3", "다른 대회 이름", "2026-05-01", "다른 대회 이름")]
    rows = spark.createDataFrame([(kinds,), ([kinds[0], ("logo", "u9", *kinds[0][2:])],)], "c array<struct<kind:string,raw:string,name:string,date:string,evidence:string>>")
    rows = rows.withColumnRenamed("c", "candidates").withColumns({"k": F.monotonically_increasing_id(), "name": F.lit("2026 서울하프마라톤"), "event_date": F.lit("2026-05-01")})
    assert [r.raw for r in resolve.logos(rows, ["k"]).orderBy("k").collect()] == ["u1", None]


@pytest.fixture()
def page(spark):
    return lambda source: spark.createDataFrame([(1, source)], "page_id bigint, html string")


def rows_of(frame):
    return [(r["name"], r["event_date"], r["detail"]) for r in frame.orderBy("at").collect()]


def test_list_parsers(page):
    assert rows_of(listing.gorunning(page('<table><tr><td><a href="/race/view.php?idx=7">Old Run</a></td><td>2026-03-01</td></tr></table>'))) == [("Old Run", "2026-03-01", "/race/view.php?idx=7")]
    assert rows_of(listing.gorunning(page('<a href="/races/abc">Bare Run</a><a href="/races/x">ab</a>'))) == [("Bare Run", "", "/races/abc")]
    assert rows_of(listing.marathongo(page('<main><a class="race-card" href="/raceDetail/domestic/a-1"><b class="title">가을런</b> 2026년 5월 3일</a><a href="../admin">x 2026.1.1</a></main>'))) == [("가을런", "2026-05-03", "/raceDetail/domestic/a-1")]
    assert rows_of(listing.kormarathon(page('<script type="application/ld+json">{"@type":"Event","name":"Big Run","startDate":"2026.5.3","identifier":"x1"}</script><div class="race"><h3>Card Run</h3>2026/6/7</div>'))) == [("Big Run", "2026-05-03", "/ko/race/x1"), ("Card Run", "2026-06-07", None)]
    assert rows_of(listing.emarathon(page('<tr class="race-item"><td><a href="/race/view/9?a=1&amp;b=2">[Full] Name <i>x</i> 링크</a></td><td>2026년 7월 8일</td></tr>'))) == [("Name x ", "2026-07-08", "/race/view/9?a=1&b=2")]
    assert rows_of(listing.maedal(page('<section class="race-card" title="Maple Run"><a href="/races/u-1">x</a><time>2026-05-03</time></section>'))) == [("Maple Run", "2026-05-03", "/races/u-1")]
    assert rows_of(listing.kaaf(page('<tr><td>2026.05.03</td><td><a href="view.asp?no=1">전국 마라톤</a><a href="x.asp">홈페이지</a></td></tr>'))) == [("전국 마라톤", "2026-05-03", "view.asp?no=1")]
    moa = '<a href="/events/%s"><h3>Moa Run</h3>2026-05-03 장소</span><span>Hall</span></a>' % ("a" * 36)
    assert rows_of(listing.marathonmoa(page(moa))) == [("Moa Run", "2026-05-03", "/events/" + "a" * 36)]
    assert rows_of(listing.marathonmoa(page('<article class="race-card"><a href="/e/1">Item Run</a> 2026.5.3</article>'))) == [("Item Run", "2026-05-03", "/e/1")]
    assert rows_of(listing.runningmap(page('<div>2026-05-03 <a href="/race/view/5">Map Run</a></div>'))) == [("Map Run", "2026-05-03", "/race/view/5")]
    assert rows_of(listing.marathonmate(page('<div class="race">2026-05-03 <a href="/race/m1">Mate Marathon</a></div>'))) == [("Mate Marathon", "2026-05-03", "/race/m1")]


def test_windows_over_markup(page):
    """Dates count by their distance in the source: markup between is counted, and a label of a neighbour is read."""
    far, near = "<i></i>" * 80, "<i></i>" * 40
    link = '<a href="/race/view/5">Map Marathon</a>'
    for parse in (listing.runningmap, listing.marathonmate):
        assert rows_of(parse(page(f"<p>2026-05-03</p>{far}{link}"))) == []
        assert rows_of(parse(page(f"<p>2026-05-03</p>{near}{link}"))) == [("Map Marathon", "2026-05-03", "/race/view/5")]
        assert rows_of(parse(page(f'{link}<b data-on="2026-05-03"></b>'))) == [("Map Marathon", "2026-05-03", "/race/view/5")]
    assert rows_of(listing.maedal(page('<img alt="Maple Run"><a class="c" href="/races/u">x</a>2026.5.3'))) == [("Maple Run", "2026-05-03", "/races/u")]
    assert rows_of(listing.kaaf(page(f'<p>2026.5.3</p>{far}<a href="v.asp">전국 마라톤</a>'))) == []
    assert listing.runningmap(page(f"{link}<p>2026-05-03 장소 : Hall</p>")).first().venue == "Hall"


def test_places_in_the_source():
    source = "<ul>\n<li class='race'>a &amp; b<br>\n<a\n HREF='x'>c</a><p>d<p>e</li>\r\n<li>f</ul >g<b>h"
    found = [(e["tag"], source[e["start"] : e["end"]]) for e in markup.page_of(source)["elements"]]
    li = source[5 : source.index("</li>") + 5]
    paragraphs = [("p", "<p>d<p>e"), ("p", "<p>e")]
    assert found == [("ul", source[: source.index("g<b>")]), ("li", li), ("br", "<br>"), ("a", "<a\n HREF='x'>c</a>"), *paragraphs, ("li", "<li>f"), ("b", "<b>h")]
    a = markup.page_of(source)["elements"][3]
    assert source[a["link"] :].startswith("HREF")


def test_registration_links(page):
    one = '\\"id\\":\\"%s\\",\\"registration_url\\":\\"https://a\\"' % ("a" * 36)
    two = '\\"id\\":\\"%s\\",\\"registration_url\\":null' % ("b" * 36)
    later = one.replace("https://a", "https://b")
    assert page(one + two + later).select(listing.registration_links(F.col("html")).alias("m")).first().m == {"a" * 36: "https://b"}


def test_files_and_documents(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("가".encode("euc-kr"))
    (tmp_path / "b.html").write_bytes("나".encode())
    assert {r.file: r.html for r in page_files.files(spark, str(tmp_path)).collect()} == {"a.html": "가", "b.html": "나"}
    row = dedupe.merged(events(spark, [{"name": "A Run", "courses": [("10K", None, None)]}]).withColumn("anchor", F.lit(0)), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    found = json.loads(page_files.document_lines(row).first().value)
    assert found["registrationDeadline"] is None and found["lastVerified"] is None and "region" not in found and found["courses"] == [{"name": "10K", "price": None}]
    metadata = spark.createDataFrame([("a", True, False), ("b", False, False), ("c", True, True)], "id string, attempted boolean, succeeded boolean")
    assert [r.status for r in page_files.run_summary(metadata).orderBy("id").collect()] == ["FAIL", "SKIP", "OK"]
    with pytest.raises(RuntimeError):
        page_files.write_events(row, metadata.where("id = 'a'"), str(tmp_path / "out"))
    page_files.write_events(row, metadata, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_listings_arrive_once(spark, tmp_path):
    from eventloom.streaming.listings import follow

    row = '<h2 id="race-2026-05-0%d"></h2><tr><td><a href="/races/%d/run/">Run %d</a></td></tr>'
    for i in (1, 2):
        spark.createDataFrame([(i, row % (i, i, i))], "page_id bigint, html string").write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark, f"{tmp_path}/in", listing.gorunning, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted((r.page_id, r["name"], r.event_date) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "Run 1", "2026-05-01"), (2, "Run 2", "2026-05-02")]


def test_addresses_of_both_families(spark):
    """As the address library tells each, in every spelling; what is no address isn't public."""
    rng = random.Random(4)
    made = []
    for net, _ in addresses.PUBLIC:
        n = ipaddress.ip_network(net)
        for at in (int(n.network_address) - 1, int(n.network_address), int(n.broadcast_address), int(n.broadcast_address) + 1, rng.randint(int(n.network_address), int(n.broadcast_address))):
            if 0 <= at < 2 ** n.max_prefixlen:
                a = (ipaddress.IPv4Address if n.version == 4 else ipaddress.IPv6Address)(at)
                made += [(x, urls.is_public(a)) for x in {str(a), a.exploded, a.exploded.upper()}]
    odd = ["", None, ":::", "1::2::3", "::g", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8", "256.1.1.1", "1.2.3", "::1.2.3.4", "2400::1%eth0", "2400:12345::"]
    rows = spark.createDataFrame([(x, p, "t") for x, p in made + [(x, False) for x in odd] + [("2400::1", True)] * 2], "address string, want boolean, low string")
    got = addresses.judged(rows, addresses.intervals(spark))
    assert got.count() == len(made) + len(odd) + 2 and got.columns == ["address", "want", "low", "public"]
    assert [tuple(r) for r in got.where("public <> want").collect()] == []
    own = addresses.judged(rows, addresses.intervals(spark, [("2400::/16", False), ("2000::/3", True)]), verdict="mine")
    assert {r.mine for r in own.where("address = '2400::1'").collect()} == {False}


def test_a_document_is_one_json_text_and_current_only_if_valid(spark, tmp_path):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = [{"name": "B Run", "date": "2026-05-02"}, {"name": "가 \"Run\"\n", "date": "2026-05-02", "notes": "x", "courses": [("10K", None, None)]}, {"name": "C Run", "date": "2026-04-30"}]
    good = dedupe.merged(events(spark, rows).withColumn("anchor", F.col("ord")), now).withColumn("application_url", F.concat(F.lit("https://site.example.com/race/"), "ord")).cache()
    sources = spark.createDataFrame([("b", True, True, 3, "ok"), ("a", False, False, 0, "")], "id string, attempted boolean, succeeded boolean, record_count bigint, message string")
    path = str(tmp_path / "out")
    version = published.publish(good, sources, "2026-01-02 03:04:05", path)
    assert published.current(spark, path) == version
    whole = json.loads("\n".join(p.read_text() for p in sorted(Path(version).glob("part-*"))))
    assert [r["name"] for r in whole["races"]] == ["C Run", "B Run", "가 \"Run\"\n"] or [r["name"] for r in whole["races"]] == ["C Run", "가 \"Run\"\n", "B Run"]
    assert [m["id"] for m in whole["collectionMetadata"]] == ["a", "b"] and whole["generatedAt"].startswith("2026-01-02T03:04:05") and "urlScheme" not in whole["races"][0]
    back, metadata, _ = published.read(spark, version)
    assert sorted(r["name"] for r in back.collect()) == sorted(r["name"] for r in good.collect()) and metadata.count() == 2
    assert [r.id for r in published.failed_sources(metadata).collect()] == ["a"]
    with pytest.raises(ValueError, match="venue 1"):
        published.publish(good.withColumn("venue", F.when(F.col("ord") == 1, "").otherwise("x")), sources, "2026-01-02 03:04:05", path)
    with pytest.raises(RuntimeError):
        published.publish(good, sources.where("id = 'a'"), "2026-01-02 03:04:05", path)
    assert published.current(spark, path) == version and len(list(Path(path).glob("v-*"))) == 1
    later = published.publish(good.limit(0), sources, "2026-01-03 00:00:00", path)
    assert published.current(spark, path) == later and published.read(spark, later)[0].count() == 0
    (Path(later) / "part-zzz.txt").write_text("{}\n")
    with pytest.raises(Exception, match="not a line of the document"):
        published.checked(spark, later).collect()


def test_places_in_a_hot_month(spark):
    """A third of all events on one date; places are those of one sorted list, whatever the blocks."""
    rows = spark.range(30_000, numPartitions=8).select((F.col("id") * 7919 % 30_000 - 500).alias("ord"), F.when(F.col("id") % 3 == 0, "2026-05-03").otherwise(F.concat(F.lit("2026-0"), F.col("id") % 9 + 1, F.lit("-1"), F.col("id") % 7)).alias("d"), F.lit("x").alias("n_"))
    rows = rows.withColumn("d", F.to_date("d")).unionByName(spark.createDataFrame([(10**6, None, "x")], rows.withColumn("d", F.to_date("d")).schema))
    want, at = {}, {}
    plain = sorted((r.d, r.ord) for r in rows.where("d is not null").collect())
    for day, ord_ in plain:
        at[f"{day:%Y-%m}"] = at.get(f"{day:%Y-%m}", 0) + 1
        want[ord_] = (f"{day:%Y-%m}", at[f"{day:%Y-%m}"])
    for block in (100, calendar.BLOCK):
        got = calendar.placed(rows, "d", "ord", block).collect()
        assert {r.ord: (r.month, r.place) for r in got} == want and all(r.n == at[r.month] for r in got) and len(got) == 30_000
    assert calendar.placed(rows.limit(0), "d", "ord").count() == 0


def test_watched_chains_say_what_totals_say(spark):
    from pyspark.sql import Observation

    page = ("https://a.kr/", "a.kr", "https://a.kr/", "ok", True, False, [], 1)
    rows = spark.createDataFrame([(0, i, f"https://a.kr/{i}", "official", [page]) for i in range(60)], STEPS)
    found = frontier.traversed(rows, run=40, per_host=30)
    watch, none = Observation(), Observation()
    frontier.watched(found, watch).write.format("noop").mode("overwrite").save()
    assert watch.get == frontier.totals(found).first().asDict()
    frontier.watched(found.limit(0), none).write.format("noop").mode("overwrite").save()
    assert set(none.get.values()) == {0}
