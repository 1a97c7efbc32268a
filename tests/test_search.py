from tandem.operators import work_pages


def test_many_questions_find_what_each_finds_alone(spark):
    words = "red Réd redder gear ring king García 화산귀환 of a é ab abc - x".split()
    works = [(i, f"{words[i % len(words)]} {words[i * 7 % len(words)]} {i % 9}", [words[i * 3 % len(words)]] if i % 2 else [], i % 5 == 0) for i in range(120)]
    df = spark.createDataFrame(works, "work_id bigint, titulo string, titulos_alternativos array<string>, destacada boolean")
    asked = ["red", "¡RÉD!", "r", "in", "ring k", "garcia", "화산", "화산귀환", "no such name", "", "¿?", "a", "d g", "redder"]
    questions = spark.createDataFrame([(q,) for q in [*asked, "red"]], "q string")
    for n in (3, 200):
        got = sorted(map(tuple, work_pages.search_titles_of(df, questions, n).collect()))
        want = sorted((q, *r) for q in asked for r in map(tuple, work_pages.search_titles(df, q, n).collect()))
        assert got == want
    assert work_pages.search_titles_of(df.limit(0), questions).count() == 0
    assert work_pages.search_titles_of(df, questions.limit(0)).count() == 0


def test_a_thousand_questions_read_the_names_once(spark):
    """However many questions there are, the plan reads the names a fixed number of times."""
    df = spark.range(300).selectExpr("id AS work_id", "concat('obra ', id, ' ', md5(string(id))) AS titulo", "array('alt') AS titulos_alternativos", "id % 2 = 0 AS destacada")
    plans = []
    for n in (5, 1000):
        questions = spark.range(n).selectExpr("substr(md5(string(id)), 3, 4) AS q")
        found = work_pages.search_titles_of(df, questions)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString().count("_names"))
    assert plans[0] == plans[1]
    assert {r.q for r in found.collect()} >= {r.q for r in questions.where("q IS NOT NULL").limit(20).collect()}
