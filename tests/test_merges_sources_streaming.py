import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirelake import schemas, storage
from hirelake.functions import text
from hirelake.operators import imports, merge, pages, search
from hirelake.sources import files, sinks
from hirelake.streaming import pipeline

COMPANY = "id long, name string, homepage_url string, recruits_url string, page_type string, post_type string, region string, hiring boolean"


def test_seed_merge_last_non_empty_wins_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", "h", None, None, None, "R", True)], COMPANY)
    rows = [(1, " a ", "", "r1", "x", "", "", "maybe"), (2, "a", "h2", "", "y", None, "", ""), (3, "b", None, "rb", "", "", "S", "no"), (4, "  ", "z", "z", "z", "z", "z", "1")]
    seed = spark.createDataFrame(rows, "line long, company_name string, homepage_url string, recruits_url string, page_type string, post_type string, region string, hiring string")
    once = merge.with_new_ids(merge.seed_merge(target, seed), target, F.col("_is_new"), "name")
    got = {r.name: (r.id, r.homepage_url, r.recruits_url, r.page_type, r.post_type, r.region, r.hiring) for r in once.collect()}
    assert got == {"a": (1, "h2", "r1", "y", None, "R", True), "b": (2, None, "rb", None, None, "S", False)}
    again = merge.seed_merge(once.drop("_is_new"), seed)
    assert {r.name: (r.id, r.homepage_url, r.recruits_url, r.page_type, r.post_type, r.region, r.hiring) for r in again.collect()} == got
    m = merge.merge_metrics(target, seed).first()
    assert (m.created, m.updated, m.skipped) == (1, 2, 1)


def test_job_upsert_twice_changes_nothing(spark):
    now, later = F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '2025-02-01 00:00:00'")
    target = spark.createDataFrame([], schemas.JOB_POSTINGS)
    fields = "line long, post_url string, company_id long, " + ", ".join(f"{c} string" for c in ("title", "salary", "location"))
    source = spark.createDataFrame([(1, "u", 5, "old", "1", "x"), (2, "u", 5, " t " * 200, "1", "x"), (3, "", 5, "t", "", ""), (4, None, 5, "t", "", ""), (5, "v", 6, "t", None, None)], fields)
    limits = {"title": 255, "salary": 255, "location": 255}
    first = merge.job_upsert(target, source, now, fields=limits)
    first = merge.with_new_ids(first, target, F.col("_change") == "inserted", "post_url")
    rows = {r.post_url: r for r in first.collect()}
    assert set(rows) == {"u", "v"} and {r["_change"] for r in rows.values()} == {"inserted"} and len(rows["u"].title) == 255 and rows["u"].is_active and sorted(r.id for r in rows.values()) == [1, 2]
    stored = first.select(*target.columns)
    changed = merge.job_upsert(stored, source, later, fields=limits)
    kinds = {r.post_url: r["_change"] for r in changed.collect()}
    assert kinds == {"u": "changed", "v": "same"}  # the update path strips, the insert path doesn't
    third = merge.job_upsert(changed.select(*target.columns), source, later, fields=limits).collect()
    assert {r["_change"] for r in third} == {"same"}
    closed = stored.withColumn("status", F.lit("closed"))
    assert {r.status for r in merge.job_upsert(closed, source, later, fields=limits).collect()} == {"active"}


def test_replace_set_and_cascade(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    s = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 3)], "k string, v int, line int")
    assert sorted(map(tuple, merge.replace_by_key(t, s, "k", "line").collect())) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(map(tuple, merge.set_values(t, s.withColumn("v", F.when(F.col("line") != 2, F.col("v"))), "k", ["v"], "line").collect())) == [("a", 1), ("b", 3)]
    assert merge.cascade_delete(t, s, "k", "k").count() == 1 and merge.duplicate_keys(s, "k").first().n == 2


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp949"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = tmp_path / "seed.csv"
    path.write_bytes('company_name,homepage_url,region\n"가나, 다",https://x,서울\n라,,\n'.encode(encoding))
    df = files.read_company_seed(spark, str(path))
    rows = [(r.company_name, r.homepage_url, r.hiring) for r in df.orderBy("line").collect()]
    assert rows == [("가나, 다", "https://x", None), ("라", None, None)]


def test_csv_errors(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b"name\n\xff\xff\xff\xff\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(bad), strict=True)
    with pytest.raises(ValueError):
        files.read_company_seed(spark, str(bad))
    assert files.read_csv(spark, str(bad)).count() == 1


def test_trainee_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("날짜,학생ID,성별,경력기간(M),복리후생,필수조건,lot_number\n2024-01-02,S1,여,6,\"식대, 재택근무\",재택,1\n,S2,남,x,,,2\n,,,,,,3\n", encoding="utf-8-sig")
    rows = {r.student_code: r for r in imports.trainee_rows(files.read_csv(spark, str(path), strict=True)).collect()}
    one = rows["S1"]
    assert set(rows) == {"S1", "S2"} and (one.counseling_date, one.gender, one.career_months, one.welfare_preferences, one.required_conditions) == (dt.date(2024, 1, 2), "F", 6, "식대,재택근무", "BENEFIT_재택근무")
    assert rows["S2"].career_months is None and rows["S2"].counseling_date is None


def test_export_and_json(spark, tmp_path):
    df = spark.createDataFrame([(2, "나", None, "r"), (1, "가", "h", None)], "id long, name string, homepage_url string, recruits_url string")
    sinks.export_csv(df, str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert data.decode("utf-8-sig").splitlines() == ["name,homepage_url,recruits_url", "가,h,", "나,,r"] and data.startswith(b"\xef\xbb\xbf")
    row = sinks.json_rows(spark.createDataFrame([(1, 2)], "id int, company_id int")).first().value
    assert row == '{"id":1,"company":2}'
    parsed = files.parse_requests(spark.createDataFrame([('{"text": "a", "only_fields": ["x"]}',), ("{broken",)], "value string")).collect()
    assert [(r.text, r.only_fields) for r in parsed] == [("a", ["x"]), (None, None)]


def test_paging_and_targets(spark):
    df = spark.range(45).withColumn("id", F.col("id"))
    assert [r.id for r in search.page(df, 3, 20).collect()] == [4, 3, 2, 1, 0] and search.page(df, 1, 1000).count() == 45
    e = search.page_envelope(df, 3, 20).first()
    assert (e["count"], e.has_next, e.has_previous) == (45, False, True)
    c = spark.createDataFrame([(1, "h", None), (2, "h", ""), (3, None, None), (4, "h", "none")], "id long, homepage_url string, recruits_url string")
    assert [r.id for r in search.discover_targets(c).collect()] == [1, 2] and [r.id for r in search.discover_targets(c, none_is_missing=True).collect()] == [1, 2, 4]
    assert [r.id for r in search.missing_homepages(c.withColumn("name", F.lit("n"))).collect()] == [3]


HTML = """<html><head><title>T</title></head><body><h1>Top</h1><div><h2>First <b>job</b></h2><p>{long}</p><p>채용 모집</p><h3>Second</h3><p>short</p></div><p>after</p></body></html>"""


def test_heading_blocks_and_postings(spark):
    long = "서울 재택근무 " * 20
    df = spark.createDataFrame([(1, "http://a/", HTML.format(long=long)), (2, "http://b/", f"<html><title>P</title><body>채용 모집 {long}</body></html>"), (3, "http://c/", None)], pipeline.PAGES)
    blocks = [(r.page_id, r.i, r.title, r.body.split()[-1] if r.body else "") for r in pages.heading_blocks(df).orderBy("page_id", "i").collect()]
    assert blocks == [(1, 0, "First  job", "모집"), (1, 1, "Second", "short")] or blocks == [(1, 0, "First job", "모집"), (1, 1, "Second", "short")]
    jobs = {r.post_url: r for r in pages.one_page_jobs(df).collect()}
    assert set(jobs) == {"http://a/#job-0", "http://b/"} and jobs["http://b/"].title == "P" and jobs["http://a/#job-0"].location == "서울" and jobs["http://b/"].benefits == "재택근무"


CUT = '<html><head><title>{t}</title></head><body><h1>{t}</h1><p>{p} &copy; &copyx; &notit;</p><a href="/p?a=1&amp;copy=2&lt=3">the</a></body></html>'.format(t="R&amp;D &#54620;&amp", p="the an que la und " * 6)


def test_page_titles_keep_references_without_an_end(spark):
    got = spark.createDataFrame([(1, "http://a/", CUT)], pipeline.PAGES).select(pages.page_title("html").alias("title")).first().title
    assert got == "R&D 한&amp"


def test_detail_pages_keep_references_without_an_end(spark):
    got = pages.detail_jobs(spark.createDataFrame([(1, "http://a/", CUT)], pipeline.PAGES), ["the", "que"]).first()
    assert got.title == "R&D 한&amp" and got.job_description.startswith("R&D 한&amp the") and got.job_description.endswith("© &copyx; &notit; the")
    assert pages.anchors(spark.createDataFrame([(1, "http://a/", CUT)], pipeline.PAGES)).first().link == "http://a/p?a=1&copy=2&lt=3"


def test_one_page_sites_keep_references_without_an_end(spark):
    got = pages.one_page_jobs(spark.createDataFrame([(1, "http://a/", CUT)], pipeline.PAGES), ["the", "que"]).first()
    assert got.title == "R&D 한&amp" and got.job_description.startswith("R&D 한&amp the")


def test_search_results(spark):
    html = '<a class="result__a" href="https://t.kr/x">T</a><a class="result__url" href="//duck/l/?uddg=https%3A%2F%2Fwww.naver.com">n</a><a class="x result__url" href="/l/?uddg=https%3A%2F%2Freal.kr%2Fp&amp;r=1">r</a>'
    only = '<a class="result__a" href="https://t.kr/x">T</a>'
    got = pages.search_candidates(spark.createDataFrame([(1, html), (2, only), (3, None)], "page_id long, html string")).collect()
    assert {r.page_id: r.homepage_url for r in got} == {1: "https://real.kr", 2: "https://t.kr"}


def test_incremental_pipeline(spark, tmp_path):
    text = "채용 모집 안내 " + "서울 정규직 경력 3년 " * 5
    page = lambda i, extra="": (i, f"http://h/{i}", f"<html><body><h1>Job {i}</h1><p>{text}{extra}</p></body></html>")
    source, store = str(tmp_path / "pages"), pipeline.ChangeLog(spark, str(tmp_path / "jobs"), schemas.JOB_POSTINGS)
    now = F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")
    spark.createDataFrame([page(1), page(2), (3, "http://h/3", "<p>no</p>")], pipeline.PAGES).write.parquet(source)
    pipeline.run_stream(spark, source, store, str(tmp_path / "check"), now).awaitTermination()
    assert sorted(r.title for r in store.read().collect()) == ["Job 1", "Job 2"]
    spark.createDataFrame([page(2, "새 글"), page(4)], pipeline.PAGES).write.mode("append").parquet(source)
    pipeline.run_stream(spark, source, store, str(tmp_path / "check"), now).awaitTermination()
    rows = store.read().collect()
    assert sorted(r.post_url for r in rows) == ["http://h/1", "http://h/2", "http://h/4"] and len({r.id for r in rows}) == 3
    assert "새 글" in next(r.job_description for r in rows if r.post_url == "http://h/2")


def test_batches_append_their_changes(spark, tmp_path):
    body = "채용 모집 안내 " + "서울 정규직 경력 3년 " * 5
    pages_of = lambda ids, more="": spark.createDataFrame([(i, f"http://h/{i}", f"<html><body><h1>Job {i}{more}</h1><p>{body}</p></body></html>") for i in ids], pipeline.PAGES)
    table = pipeline.ChangeLog(spark, str(tmp_path / "jobs"), schemas.JOB_POSTINGS)
    now = F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")
    assert table.read().count() == 0
    pipeline.upsert_batch(table, pipeline.posting_rows(pages_of(range(20))), now)
    merged = pipeline.upsert_batch(table, pipeline.posting_rows(pages_of([3, 100])), now)
    assert sorted(r._change for r in merged.collect()) == ["inserted", "same"]
    table.compact()
    pipeline.upsert_batch(table, pipeline.posting_rows(pages_of([4], " new")), now)
    assert [(r.batch, r["count"]) for r in table.log().groupBy("batch").count().orderBy("batch").collect()] == [(0, 20), (1, 1), (2, 1)]
    rows = {r.post_url: r for r in table.read().collect()}
    assert len(rows) == 21 and sorted(r.id for r in rows.values()) == list(range(1, 22)) and rows["http://h/4"].title == "Job 4 new" and table.head().top == 21
    table.compact()
    pipeline.upsert_batch(table, pipeline.posting_rows(pages_of([])), now)
    assert {p.name for p in (tmp_path / "jobs" / "rows").iterdir()} == {"batch=1", "batch=2", "batch=3"} and {p.name for p in (tmp_path / "jobs" / "base").iterdir()} == {"batch=1", "batch=2"}
    assert {r.post_url: r for r in table.read().collect()} == rows


def test_kept_counts_are_those_of_a_recount(spark, tmp_path, monkeypatch):
    """Values come, go and become null; compactions and a killed update lie between."""
    table = pipeline.ChangeLog(spark, str(tmp_path / "log"), "k long, v string", "k")
    kept = pipeline.KeptCounts(table, str(tmp_path / "counts"), "v")
    batches = [[(1, "a"), (2, "a"), (3, None)], [(2, "b"), (4, "a")], [(1, None), (3, "c"), (2, "a")], [], [(1, "a")]]
    state: dict = {}
    for i, rows in enumerate(batches):
        table.append(spark.createDataFrame([(*r, "changed") for r in rows], "k long, v string, _change string"), i, 0)
        state.update(rows)
        if i == 2:
            with monkeypatch.context() as m:
                m.setattr(kept.own, "_commit", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    kept.update()
            table.compact()
        if i != 1:
            kept.update()
            kept.update()
            assert {r.value: r.n for r in kept.counts().collect()} == {v: list(state.values()).count(v) for v in set(state.values())}


def test_a_killed_batch_counts_once(spark, tmp_path, monkeypatch):
    """Killed after the rows are written and before the commit; delivered again after the commit."""
    page = lambda i: (i, f"http://h/{i}", f"<html><body><h1>Job {i}</h1><p>채용 모집 안내 {'서울 정규직 경력 3년 ' * 5}</p></body></html>")
    first, second = (pipeline.posting_rows(spark.createDataFrame([page(i) for i in ids], pipeline.PAGES)) for ids in ((1, 2), (2, 3)))
    table = pipeline.ChangeLog(spark, str(tmp_path / "jobs"), schemas.JOB_POSTINGS)
    now = F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pipeline.upsert_batch(table, first, now, "s", 0)
    assert table.read().count() == 0
    pipeline.upsert_batch(table, first, now, "s", 0)
    again = pipeline.upsert_batch(table, second, now, "s", 0)
    assert sorted(r.post_url for r in again.collect()) == sorted(r.post_url for r in table.read().collect()) == ["http://h/1", "http://h/2"]
    pipeline.upsert_batch(table, second, now, "s", 1)
    pipeline.upsert_batch(table, second, now, "other", 0)
    assert sorted((r.post_url, r.id) for r in table.read().collect()) == [("http://h/1", 1), ("http://h/2", 2), ("http://h/3", 3)]


def test_the_schedule_runs_again_and_again(spark, tmp_path):
    page = lambda i: (i, f"http://h/{i}", f"<html><body><h1>Job {i}</h1><p>채용 모집 안내 {'서울 정규직 경력 3년 ' * 5}</p></body></html>")
    source, table = str(tmp_path / "pages"), pipeline.ChangeLog(spark, str(tmp_path / "jobs"), schemas.JOB_POSTINGS)
    spark.createDataFrame([page(1)], pipeline.PAGES).write.parquet(source)
    query = pipeline.run_stream(spark, source, table, str(tmp_path / "check"), F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'"), interval="1 second")
    try:
        query.processAllAvailable()
        assert table.read().count() == 1
        spark.createDataFrame([page(2)], pipeline.PAGES).write.mode("append").parquet(source)
        query.processAllAvailable()
        assert table.read().count() == 2 and query.isActive
    finally:
        query.stop()


def test_finish_keeps_to_its_own_thread(spark):
    from threading import Thread

    from hirelake import storage

    others: list = []
    write = lambda: others.append(storage.materialise(spark.range(3), "other"))

    def make():
        inner = storage.materialise(spark.range(5), "inner")
        thread = Thread(target=write)
        thread.start()
        thread.join()
        return inner.where("id > 1")

    result = storage.finish(make, "result")
    assert result.count() == 3 and others[0].count() == 3
    storage.release(result)
    storage.release(others[0])
    assert not any("hirelake-inner" in p or "hirelake-other" in p or "hirelake-result" in p for p in storage._written)


def test_last_page_of_a_url_counts(spark):
    rows = [(1, "u", "old"), (2, "u", "new"), (3, "v", None), (3, "v", "x")]
    got = pipeline.last_pages(spark.createDataFrame(rows, pipeline.PAGES)).collect()
    assert {(r.page_id, r.url, r.html) for r in got} == {(2, "u", "new"), (3, "v", "x")}


def test_csv_folder_and_late_bytes(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text("name,memo\n" + "".join(f'n{i}-{k},"a\nb"\n' for k in range(4)), encoding="utf-8")
    rows = [r.name for r in files.read_csv(spark, str(folder)).orderBy("line").collect()]
    assert rows == [f"n{i}-{k}" for i in range(3) for k in range(4)]
    late = tmp_path / "late.csv"
    late.write_bytes(b"name\n" + b"plain\n" * 300_000 + "가나\n".encode("cp949"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert files.detect_encoding(spark, str(late)) == "cp949"
    assert files.read_csv(spark, str(late)).where("name = '가나'").count() == 1
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_references_and_markup(spark):
    rows = ["R&amp;D &#54620;&#xAD6D; &copy &copy; &nbsp;x &unknown; & &#0; &#xD800; &amp;lt;", None, "", "plain", '<a title="x > y">t</a><!-- <b>gone --> a < b', "<b>un</b>closed <i"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = [r.y for r in df.select("i", text.unescape("x").alias("y")).orderBy("i").collect()]
    assert got[0] == "R&D 한국 &copy © \u00a0x &unknown; & \ufffd \ufffd &lt;" and got[1:4] == [None, "", "plain"]
    assert [r.y for r in df.select("i", text.node_text("x").alias("y")).orderBy("i").collect()][4:] == ["t a < b", "un closed <i"]


def test_titles_are_first_direct_text(spark):
    cases = [
        ("<h1>Lead <b>engineer</b> role</h1>", "Lead"),
        ("<h1><b>Lead</b> role</h1>", "role"),
        ("<h1>\n<b>x</b></h1><h1>y</h1><title>t</title>", ""),
        ("<h1><b>x</b></h1><h1>A&amp;B</h1>", "A&B"),
        ("<h1><b>x</b></h1><h2 class='a > b'><br>two</h2>", "two"),
        ("<title>only &#84;</title>", "only T"),
        ("<p>none</p>", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    assert [r.t for r in df.select("i", pages.page_title("html").alias("t")).orderBy("i").collect()] == [t for _, t in cases]


def test_links_are_decoded(spark):
    html = '<a data-title="no" title="a &gt; b" href="/x?a=1&amp;b=2">R&amp;D &#54620;</a><a title="x > y" href=\'q\'>t</a><a>none</a>'
    got = pages.anchors(spark.createDataFrame([(1, "http://a/p/", html)], pipeline.PAGES)).orderBy("pos").collect()
    assert [(r.link, r.text, r.label) for r in got] == [("http://a/x?a=1&b=2", "R&D 한", "a > b"), ("http://a/p/q", "t", "x > y"), (None, "none", "")]


def test_storage_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
    made = []

    def work():
        made.append(storage.materialise(spark.range(5), "inner"))
        return made[0].where("id > 2")

    out = storage.finish(work, "outer")
    assert out.count() == 2
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(*made[0].inputFiles()).count()


def test_only_elements_count(spark):
    """Comments, scripts, unclosed links, left-out end tags, bases and quoted brackets."""
    cases = [
        ("<!-- <a href='/old'>old</a> --><a href=/new>new</a>", [("http://a/new", "new")]),
        ("<script>var t='<a href=\"/js\">js</a>'</script><a href='x'>x</a>", [("http://a/p/x", "x")]),
        ("<ul><li><a href='1'>one<li><a href='2'>two</ul><p>after", [("http://a/p/1", "one"), ("http://a/p/2", "two")]),
        ("<a href='1'>one <a href='2'>two</p> more", [("http://a/p/1", "one"), ("http://a/p/2", "two more")]),
        ("<head><base href='//b.kr/d/'></head><a href='x'>x</a><a href='/y'>y</a><base href='/no'>", [("http://b.kr/d/x", "x"), ("http://b.kr/y", "y")]),
        ("<a title='a > b' href='../up'>u<b>p</b></a><a href>e</a><a href='http://[x'>bad</a>", [("http://a/up", "u p"), (None, "e"), (None, "bad")]),
        ("<A HREF='q'>Q</A \n><style>a > b {}</style><a href='r'>cut <i", [("http://a/p/q", "Q"), ("http://a/p/r", "cut")]),
        ("<script>no end <a href='z'>z</a>", []),
        (None, []),
    ]
    df = spark.createDataFrame([(i, "http://a/p/", h) for i, (h, _) in enumerate(cases)], pipeline.PAGES)
    got: dict = {i: [] for i in range(len(cases))}
    for r in pages.anchors(df).orderBy("page_id", "pos").collect():
        got[r.page_id].append((r.link, r.text))
    assert list(got.values()) == [want for _, want in cases]
    titles = spark.createDataFrame([(0, "<!-- <h1>Old title</h1> --><h1>New title</h1>"), (1, "<script>'<h1>x</h1>'</script><title>T &lt;b&gt;</title><h2> two"), (2, "<h1>a<h1>b")], "i int, html string")
    assert [r.t for r in titles.select("i", pages.page_title("html").alias("t")).orderBy("i").collect()] == ["New title", "two", "a"]
    body = spark.createDataFrame([(1, "u", "<title>t</title><head><script>s</script></head><body>x<p>y<script>z</script>&amp;<!--c--></body>"), (2, "u", "no body <title>t</title> here")], pipeline.PAGES)
    assert [r.page_text for r in pages.page_text(body).orderBy("page_id").collect()] == ["x y z &", "no body here"]


def test_heading_blocks_of_unclosed_elements(spark):
    html = "<div><h2>A<p>no<b>t</b></h2><p>one<p><b>two<h3>B</h3>text <i>it</i><ul><li>x<li>y</ul><h1>C</h1><p>z</div><p>out"
    got = [(r.i, r.title, r.body) for r in pages.heading_blocks(spark.createDataFrame([(1, "u", html)], pipeline.PAGES)).orderBy("i").collect()]
    assert got == [(0, "A no t", "one two"), (1, "B", "it x y")]


def test_most_of_a_kind_is_the_count_by_groups(spark):
    html = "".join(f"<a href='/{c}/x/{i}' title='the'>{t}</a>" for i, (c, t) in enumerate([("a", "the"), ("b", "the"), ("a", ""), ("a", "zz"), ("b", ""), ("b", "the")]))
    df = spark.createDataFrame([(1, "http://a/", html), (2, "http://a/", "<a>the</a>"), (3, "http://a/", None)], pipeline.PAGES)
    wide = {r.page_id: r.n for r in pages.read_pages(df, "anchors").select("page_id", pages.most_of_a_kind("anchors", ["the"]).alias("n")).collect()}
    assert wide == {1: 3, 2: 0, 3: 0} and [(r.page_id, r.most) for r in pages.listing_counts(pages.anchors(df), ["the"]).collect()] == [(1, 3)]
