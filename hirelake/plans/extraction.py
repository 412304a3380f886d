"""Queries over texts: tokens, money, counselling facts, posting facts, import helpers.

Korean defaults meet Latin test tables, so corpus-wide queries pass Latin lists, and the default
lists run over documents that begin with one of the sentences of NOTES, laid in by the same SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake import lexicons as L
from hirelake.functions import extract, model, posting
from hirelake.functions import text as T
from hirelake.functions.lexicon import lexicon_hits as hits_of
from hirelake.operators import imports
from hirelake.plans import inputs
from hirelake.plans import sqltext as S
from hirelake.sources.files import parse_requests, safe_json

NOTES = [
    (1, "서울 또는 판교 근무 희망, 재택 가능하면 좋음. Python, Django, React 경험. 연봉 3,700 이상."),
    (2, "반드시 수도권에서 일해야 합니다. 급여는 최소 4,000만원 필수! 경력 3년"),
    (3, "1억 2,300만 희망. 게임 회사, AWS Kubernetes Docker 필수. 건강 검진과 스톡옵션"),
    (4, "지역 무관, 인원 120명 이상. 데이터 SQL mysql"),
    (5, ""),
    (6, "부산 신입 급여 협의 사내스터디 도서구입비 <b>핀테크</b>&nbsp;결제"),
    (7, "자격 요건: 3년 Python 우대 사항 Django 전형 절차 - 서류 면접 복리후생 식대, 재택근무"),
    (8, "정규직 채용 모집, 연봉 4,500 만원 별도, 대구"),
]
_SENTENCE = "CASE doc_id % 8 " + " ".join(f"WHEN {i - 1} THEN {S.text(t)}" for i, t in NOTES) + " END"
NOTED = f"(SELECT doc_id AS id, concat({_SENTENCE}, ' ', coalesce(text, '')) AS text FROM documents) AS notes"
LATIN = extract.Rules(
    people=r"(\d{1,5})\s*(?:mail|user|en)",
    industries=[("one", ["tionth", "ungsch"]), ("two", ["mentre", "queo"]), ("three", ["the"])],
    experienced="ing",
    career=("both", "new"),
    everywhere=["ersh", "zzz"],
    elsewhere=["ouer"],
    metro=["ungen", "osa", "tion"],
    province=["la", "de"],
    places=("anywhere", "elsewhere", "metro"),
    tech=["the", "go", "nest", "ai", "tion", "ment", "que", "ung", "los", "sch", "and", "est", "data", "bert", "ea", "er", "on"],
    tech_upper=["ai", "que"],
    benefits=["and", "le", "und", "que"],
    synonyms={"thing": "and", "tion": "le", "ich": "und"},
    triggers=["the", "und", "que"],
    required_place=["or", "en"],
    required_pay=["re"],
    required_limits=["st"],
    required_welfare=["wh"],
    required_career=["nd"],
)
_LOW = "lower(t)"
_CLEAN = f"(SELECT id, {S.clean_html('coalesce(text, %s)' % S.text(''))} AS t FROM %s)"


def _facts(df, rules):
    names = ("people", "industry", "career", "skills_text", "place", "pay", "stack", "benefits", "required")
    got = extract.extract_facts(df, "text", rules=rules, names=names)
    return got.select("id", "people", "industry", "career", "skills_text", "place", F.col("pay").cast("bigint").alias("pay"), F.array_join("stack", ",").alias("stack"), F.array_join("benefits", ",").alias("benefits"))


def _facts_sql(source: str, r: extract.Rules) -> str:
    people = r.people.replace("(?U)", "")
    industry = "CASE " + " ".join(f"WHEN {S.any_in(_LOW, keys)} THEN {S.text(label)}" for label, keys in r.industries) + " END"
    shown = f"list_transform({S.found_in(_LOW, r.tech)}, lambda k: CASE WHEN list_contains({S.array(r.tech_upper)}, k) THEN upper(k) ELSE concat(upper(k[1]), lower(k[2:])) END)"
    benefits = "list_filter([" + ", ".join(f"CASE WHEN {S.any_in(_LOW, [k for k, v in r.synonyms.items() if v == b]) if b in r.synonyms.values() else 'false'} OR contains(t, {S.text(b)}) THEN {S.text(b)} END" for b in r.benefits) + "], lambda x: x IS NOT NULL)"
    bare = "replace(lower(t), ',', '')"
    pay = (
        f"list_max(list_concat([try_cast(nullif(regexp_extract({bare}, '([0-9]+)\\s*억', 1), '') AS BIGINT) * 10000], "
        f"list_transform(regexp_extract_all({bare}, '([0-9]{{3,5}})\\s*만', 1), lambda x: CAST(x AS BIGINT)), "
        f"list_transform(list_filter(regexp_extract_all({bare}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[0-9]{{3,5}}')), lambda x: CAST(x AS BIGINT))))"
    )
    return f"""WITH c AS {_CLEAN % source}, s AS (SELECT *, {shown} AS got FROM c)
        SELECT id, list_max(list_transform(regexp_extract_all(t, {S.text(people)}, 1), lambda x: CAST(x AS INTEGER))) AS people, {industry} AS industry,
          CASE WHEN contains(t, {S.text(r.experienced)}) THEN {S.text(r.career[0])} ELSE {S.text(r.career[1])} END AS career,
          CASE WHEN len(got) > 0 THEN array_to_string(got[1:5], ', ') END AS skills_text,
          CASE WHEN {S.any_in('t', r.everywhere)} THEN {S.text(r.places[0])} WHEN {S.any_in('t', r.elsewhere)} THEN {S.text(r.places[1])}
               WHEN {S.any_in('t', r.metro)} THEN {S.text(r.places[2])} WHEN {S.any_in('t', r.province)} THEN {S.text(r.places[1])} END AS place,
          {pay} // 500 * 500 AS pay, array_to_string(got[1:15], ',') AS stack, array_to_string({benefits}, ',') AS benefits FROM s"""


def _turns(spark, sf):
    return inputs.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _notes(spark, sf):
    inputs.register(spark, sf, "documents")
    return spark.sql(f"SELECT * FROM {NOTED}")


def tokenize_set(spark, sf):
    return _turns(spark, sf).select("id", F.array_join(F.array_sort(T.token_set("text")), " ").alias("tokens"))


def welfare_canon(spark, sf):
    return inputs.jobs(spark, sf).select("id", F.array_join(T.welfare_set(T.token_set("benefits")), ",").alias("welfare"))


def salary_min_parse(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", T.salary_min("text").alias("least"))


def salary_floor500(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", T.salary_floor500("text").alias("pay"))


def clean_html(spark, sf):
    return inputs.table(spark, sf, "pages").select("page_id", T.clean_html("html").alias("text"))


def extract_counseling(spark, sf):
    return _facts(_turns(spark, sf), LATIN)


def extract_counseling_korean(spark, sf):
    return _facts(_notes(spark, sf), extract.DEFAULT)


def extract_stack(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", F.array_join(extract.stack(F.col("text")), ",").alias("stack"))


def required_fields(spark, sf):
    return _turns(spark, sf).select("id", F.array_join(extract.required(T.clean_html("text"), LATIN), ",").alias("required"))


def only_fields(spark, sf):
    return extract.extract_facts(_turns(spark, sf), "text", ["career", "place", "unknown"], LATIN, ("people", "industry", "career", "skills_text", "place", "pay", "stack", "benefits", "required")).select("id", "career", "place")


def labeled_block(spark, sf):
    block = posting.labeled_block(T.collapse("text"), ["Licensed under", "the"], ["License", "of", "and"])
    return inputs.table(spark, sf, "documents").select("doc_id", block.alias("block"))


def posting_extract(spark, sf):
    facts = posting.posting_facts("text")
    return _notes(spark, sf).select("id", *[facts[c].alias(c) for c in ("benefits", "location", "employment_type", "salary")])


def posting_words(spark, sf):
    t = "text"
    return inputs.table(spark, sf, "documents").select(
        "doc_id", posting.benefit_list(t, ["the", "que", "und", "los"]).alias("benefits"), posting.region(t, ["ersh", "ungen", "ment"]).alias("region"),
        posting.employment_type(t, ["full", "tion"]).alias("kind"), posting.salary_phrase(t, "src|mail", r"\d[\d,\.]+").alias("pay"),
    )


def accept_as_job(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", posting.accept_as_job("text", ["ersh", "oner", "lichkeit", "mentre", "queo"]).alias("accepted"))


def accept_with_classifier(spark, sf):
    """A plugged-in classifier accepts what the words alone would not."""
    accepted = posting.accept_as_job("text", ["ersh", "oner", "lichkeit"], classifier=lambda head: head.contains("que") & F.lower(head).contains("le"))
    return inputs.table(spark, sf, "documents").select("doc_id", accepted.alias("accepted"))


def has_digit(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", T.has_digit("text").alias("has"))


def counseling_requests(spark, sf):
    """JSON request bodies made of the turns, every seventh one broken, read back as columns."""
    body = F.to_json(F.struct(F.col("text"), F.array(F.lit("급여")).alias("only_fields")))
    rows = _turns(spark, sf).select("id", F.when(F.col("id") % 7 == 0, F.lit("{broken")).otherwise(body).alias("value"))
    return parse_requests(rows).select("id", "text", F.array_join("only_fields", ",").alias("fields"))


def import_helpers(spark, sf):
    return inputs.jobs(spark, sf).select(
        "id", imports.welfare_list("benefits").alias("welfare"), imports.required_codes("benefits").alias("codes"), imports.to_int(F.split("salary", " ")[0]).alias("no_number"),
        imports.to_int(F.concat(F.lit(" "), F.col("id").cast("string"), F.lit(" "))).alias("number"), imports.gender(F.when(F.col("id") % 3 == 0, "여자").when(F.col("id") % 3 == 1, " 남")).alias("gender"),
    )


def import_dates(spark, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("n/a")
    return inputs.table(spark, sf, "orders").select("o_orderkey", imports.to_date(raw).alias("day"))


def json_decode(spark, sf):
    return inputs.table(spark, sf, "events").select("event_id", safe_json("props", "k int")["k"].alias("k"))


def _stand_in() -> model.Model:
    """A stand-in for a trained model: it goes by letters of the text."""
    return lambda texts, labels: [(labels[len(t) % len(labels)], 0.9 if "que" in t else 0.5 if "th" in t else 0.1) for t in texts]


def extract_with_model(spark, sf):
    """Facts with a supplied model: it fills a missing place and overrides the career."""
    inputs.register(spark, sf, "conversations")
    rows = spark.sql(f"SELECT id, text FROM {_TURNS}")
    got = extract.extract_facts(rows, rules=LATIN, corrector=model.fact_corrector("stand-in", _stand_in))
    return got.select("id", F.col("구인구분").alias("career"), F.col("근무지").alias("place"))


def accept_with_model(spark, sf):
    """Postings by a supplied model on the first 2000 characters, or by words."""
    accepted = posting.accept_as_job("text", ["ersh", "oner", "lichkeit"], classifier=model.posting_classifier("stand-in", _stand_in))
    return inputs.table(spark, sf, "documents").select("doc_id", accepted.alias("accepted"))


#: Words of three to five letters of the benchmark table, a bounded table, as a lexicon; many lie in others.
LEXICON = "SELECT DISTINCT w FROM (SELECT {explode}({split}(lower(text), '[^a-z]+')) AS w FROM benchmark) AS x WHERE length(w) BETWEEN 3 AND 5"
LEXICON_WORDS = 50_000


def lexicon_hits(spark, sf):
    """Which words of a lexicon each whole document contains, overlapping ones included."""
    inputs.register(spark, sf, "benchmark", "documents")
    rows = spark.sql(LEXICON.format(explode="explode", split="split")).orderBy("w").limit(LEXICON_WORDS + 1).collect()
    if len(rows) > LEXICON_WORDS:
        raise ValueError("the lexicon is too large for one automaton")
    docs = spark.table("documents").select("doc_id", F.lower("text").alias("low"))
    return hits_of(docs, {"hits": "low"}, [r.w for r in rows]).select("doc_id", F.array_join("hits", ",").alias("hits"))


QUERIES = {f.__name__: f for f in (tokenize_set, welfare_canon, salary_min_parse, salary_floor500, clean_html, extract_counseling, extract_counseling_korean, extract_stack, required_fields, only_fields, labeled_block, posting_extract, posting_words, accept_as_job, accept_with_classifier, has_digit, counseling_requests, import_helpers, import_dates, json_decode, lexicon_hits, extract_with_model, accept_with_model)}

_TURNS = "(SELECT conv_id * 1000 + turn AS id, text FROM conversations) AS turns"
_bare = "replace(lower(text), ',', '')"


def _required_sql(r: extract.Rules) -> str:
    place, pay, welfare, career, stack, skill, people, industry = r.names
    low = "lower(x)"
    many = f"len(list_distinct({S.found_in(low, r.tech)})) >= 2"
    implied = S.any_in(low, list(r.synonyms)) + " OR " + S.any_in("x", r.benefits)
    tests = [
        (S.any_in("x", r.required_place), place),
        (f"{S.any_in('x', r.required_pay)} AND (regexp_matches(x, '[0-9]') OR {S.any_in('x', r.required_limits)})", pay),
        (f"{S.any_in('x', r.required_welfare)} OR {implied}", welfare),
        (S.any_in("x", r.required_career), career),
        (many, stack),
        (many, skill),
        (f"regexp_matches(x, {S.text(r.people)})", people),
        (S.any_in(low, [k for _, keys in r.industries for k in keys]), industry),
    ]
    cases = ", ".join(f"CASE WHEN {t} THEN {S.text(n)} END" for t, n in tests)
    return f"""WITH c AS {_CLEAN % _TURNS}, p AS (SELECT id, regexp_split_to_array(regexp_replace(t, '([.?!])', '\\1' || chr(1), 'g'), chr(1) || '|[。？！\\n\\r]') AS parts FROM c),
        s AS (SELECT id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS nr FROM p), k AS (SELECT id, nr, {S.strip('raw')} AS x FROM s),
        e AS (SELECT id, nr, [{cases}] AS hits FROM k WHERE x <> '' AND {S.any_in('x', r.triggers)}),
        u AS (SELECT id, nr, unnest(hits) AS name, generate_subscripts(hits, 1) AS nth FROM e),
        f AS (SELECT id, name, min(nr * 100 + nth) AS first FROM u WHERE name IS NOT NULL GROUP BY id, name),
        g AS (SELECT id, string_agg(name, ',' ORDER BY first) AS required FROM f GROUP BY id)
        SELECT c.id, coalesce(g.required, '') AS required FROM c LEFT JOIN g ON c.id = g.id"""


def _label_sql(labels: list[str], terms: list[str]) -> str:
    stop = "|".join(terms)
    out = "''"
    for label in reversed(labels):
        rest = f"regexp_extract(t, '(?i){label}\\s*[:-]?\\s*(.+)$', 1)"
        cut = f"{S.strip(f'concat({rest}[1], regexp_extract({rest}[2:], {S.text(f'(?i)^(.*?)(?:{stop}|$)')}, 1))')}"
        out = f"CASE WHEN {rest} <> '' THEN {cut} ELSE {out} END"
    return out


SQL = {
    "tokenize_set": f"SELECT id, array_to_string(list_sort({S.token_set('text')}), ' ') AS tokens FROM {_TURNS}",
    "welfare_canon": f"WITH jobs AS ({inputs.JOBS}) SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform({S.token_set('benefits')}, lambda w: {S.welfare('w', L.WELFARE_RULES)}), lambda w: w IS NOT NULL))), ',') AS welfare FROM jobs",
    "salary_min_parse": f"SELECT doc_id, {S.salary_min('text')} AS least FROM documents",
    "salary_floor500": f"SELECT doc_id, list_max(list_concat([try_cast(nullif(regexp_extract({_bare}, '([0-9]+)\\s*억', 1), '') AS BIGINT) * 10000], list_transform(regexp_extract_all({_bare}, '([0-9]{{3,5}})\\s*만', 1), lambda x: CAST(x AS BIGINT)), list_transform(list_filter(regexp_extract_all({_bare}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[0-9]{{3,5}}')), lambda x: CAST(x AS BIGINT)))) // 500 * 500 AS pay FROM documents",
    "clean_html": f"SELECT page_id, {S.clean_html('html')} AS text FROM pages",
    "extract_counseling": _facts_sql(_TURNS, LATIN),
    "extract_counseling_korean": _facts_sql(NOTED, extract.DEFAULT),
    "extract_stack": f"SELECT doc_id, array_to_string(list_transform({S.found_in('lower(text)', L.TECH)}, lambda k: CASE WHEN list_contains({S.array(L.TECH_UPPER)}, k) THEN upper(k) ELSE concat(upper(k[1]), lower(k[2:])) END)[1:15], ',') AS stack FROM documents",
    "required_fields": _required_sql(LATIN),
    "only_fields": f"SELECT id, career, place FROM ({_facts_sql(_TURNS, LATIN)})",
    "labeled_block": f"SELECT doc_id, {_label_sql(['Licensed under', 'the'], ['License', 'of', 'and'])} AS block FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)",
    "posting_extract": f"SELECT id, array_to_string(list_sort({S.found_in('text', L.BENEFITS)}), ', ') AS benefits, {S.first_in('text', L.REGIONS, S.text(''))} AS location, {S.first_in('text', L.EMPLOYMENT_TYPES, S.text(''))} AS employment_type, {S.strip('regexp_extract(text, %s)' % S.text('(연봉|급여)[^0-9]*([0-9][0-9,.]+ ?만원|[0-9][0-9,.]+ ?억|협의)'))} AS salary FROM {NOTED}",
    "posting_words": f"SELECT doc_id, array_to_string(list_sort({S.found_in('text', ['the', 'que', 'und', 'los'])}), ', ') AS benefits, {S.first_in('text', ['ersh', 'ungen', 'ment'], S.text(''))} AS region, {S.first_in('text', ['full', 'tion'], S.text(''))} AS kind, {S.strip('regexp_extract(text, %s)' % S.text('(src|mail)[^0-9]*([0-9][0-9,.]+)'))} AS pay FROM documents",
    "accept_as_job": f"SELECT doc_id, {S.count_in('lower(text[1:3000])', ['ersh', 'oner', 'lichkeit', 'mentre', 'queo'])} >= 2 AS accepted FROM documents",
    "accept_with_classifier": f"SELECT doc_id, (contains(text[1:2000], 'que') AND contains(lower(text[1:2000]), 'le')) OR {S.count_in('lower(text[1:3000])', ['ersh', 'oner', 'lichkeit'])} >= 2 AS accepted FROM documents",
    "has_digit": "SELECT doc_id, regexp_matches(text, '\\p{Nd}') AS has FROM documents",
    "counseling_requests": f"SELECT id, CASE WHEN id % 7 <> 0 THEN text END AS text, CASE WHEN id % 7 <> 0 THEN '급여' END AS fields FROM {_TURNS}",
    "import_helpers": f"WITH jobs AS ({inputs.JOBS}) SELECT id, array_to_string(list_sort({S.found_in('replace(benefits, %s, %s)' % (S.text(' '), S.text('')), L.BENEFITS)}), ',') AS welfare, concat_ws(',', CASE WHEN contains(benefits, '식대') THEN 'BENEFIT_식대' END, CASE WHEN contains(benefits, '재택') THEN 'BENEFIT_재택근무' END) AS codes, CAST(NULL AS INTEGER) AS no_number, CAST(id AS INTEGER) AS number, CASE id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '' END AS gender FROM jobs",
    "import_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "lexicon_hits": f"WITH lexicon AS (SELECT list(w ORDER BY w) AS words FROM ({LEXICON.format(explode='unnest', split='regexp_split_to_array')})) SELECT doc_id, coalesce(array_to_string(list_filter((SELECT words FROM lexicon), lambda w: contains(lower(text), w)), ','), '') AS hits FROM documents",
    "extract_with_model": f"""SELECT f.id, CASE WHEN t = '' THEN f.career ELSE {S.array(model.CAREERS)}[length(t) % 2 + 1] END AS career, coalesce(f.place, CASE WHEN t <> '' THEN {S.array(model.PLACES)}[length(t) % 3 + 1] END) AS place
        FROM ({_facts_sql(_TURNS, LATIN)}) f JOIN {_CLEAN % _TURNS} c ON f.id = c.id""",
    "accept_with_model": f"SELECT doc_id, coalesce(length(text[1:2000]) > 0 AND length(text[1:2000]) % 2 = 0 AND contains(text[1:2000], 'que'), false) OR {S.count_in("lower(coalesce(text, '')[1:3000])", ['ersh', 'oner', 'lichkeit'])} >= 2 AS accepted FROM documents",
    "json_decode": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
}
