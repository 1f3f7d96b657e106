"""Scalar functions: values that any engine of this kind must give."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tributary.functions import arrays, contact, dates, dims, places, similarity, skills, text
from tributary.operators import mapping


def day():
    return F.lit("2024-06-15").cast("date")


def values(spark, f, given, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, v {kind}")
    return [r.r for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def check(spark, f, pairs, kind="string"):
    assert values(spark, f, [a for a, _ in pairs], kind) == [b for _, b in pairs]


def test_clean(spark):
    check(spark, text.clean, [("  a \t b\n", "a b"), ("line1\nline2\tword", "line1 line2 word"), ("a\x01b\x7f", "ab"), ("a \x01 b", "a b"), (" x y", "x y"), ("", None), (" \n", None), (None, None), ("é", "é")])


def test_names(spark):
    check(spark, text.title_name, [("john doe", "John Doe"), ("MARY O'BRIEN", "Mary O'Brien"), ("jean-luc picard", "Jean-Luc Picard"), ("", None), (None, None)])
    check(spark, text.company_case, [("acme corp", "Acme CORP"), ("foo inc.", "Foo INC."), ("MIT", "Mit"), ("a  b", "A B"), (None, None)])
    parts = lambda c: F.concat_ws("|", *(F.coalesce(text.split_name(c)[k], F.lit("-")) for k in ("first", "middle", "last")))
    check(spark, parts, [("John Doe", "John|-|Doe"), ("John Michael Q Doe", "John|Michael Q|Doe"), ("Doe, John", "John|-|Doe"), ("Doe, John Q", "John|Q|Doe"), ("Cher", "Cher|-|-"), ("Doe,", "-|-|Doe"), (None, "-|-|-")])
    check(spark, lambda c: text.truncate(c, 4), [("abcd", "abcd"), ("abc defg", "abc…"), (None, None)])


def test_lists(spark):
    check(spark, arrays.distinct_ignoring_case, [([" a", "A", "b ", "", "B"], ["a", "b"]), ([], []), (None, [])], "array<string>")
    check(spark, arrays.string_list, [("a; b,,c ", ["a", "b", "c"]), ("", []), (None, [])])
    check(spark, lambda c: arrays.split_by_first(c, ("|", ";", ",")), [("a,b|c", ["a,b", "c"]), ("a, b", ["a", "b"]), ("x", ["x"]), (None, [])])


def test_emails(spark):
    check(spark, contact.normal_email, [("Test@Example.COM", "test@example.com"), ("a.b+tag@gmail.com", "ab@gmail.com"), ("a.b+tag@x.org", "a.b@x.org"), ("nope", None), ("a@b", None), ("a..b@x.org", None), ("", None), (None, None)])
    check(spark, contact.normal_emails, [(["A@x.org", "bad", "a@x.org", None], ["a@x.org"]), (None, [])], "array<string>")


def test_phones(spark):
    check(spark, contact.normal_phone, [("(415) 555-0198", "+14155550198"), ("+1 415.555.0198", "+14155550198"), ("Tel: 1-415-555-0198", "+14155550198"), ("+44 20 7946 0958", "+442079460958"), ("123", None), ("not a phone", None), ("", None), (None, None)])


def test_urls(spark):
    check(
        spark,
        contact.normal_url,
        [("Example.COM/a/", "https://example.com/a"), ("http://EXAMPLE.com:80", "http://example.com/"), ("https://h:8443/x?q=1#f", "https://h:8443/x"), ("https://u:p@H/x", "https://h/x"), ("https://www.linkedin.com/in/x/", "https://www.linkedin.com/in/x"), ("", None), ("https:///x", None), (None, None)],
    )
    check(spark, contact.platform, [("https://LinkedIn.com/in/x", "linkedin"), ("https://github.com/x", "github"), ("https://twitter.com/x", "twitter"), ("https://stackoverflow.com/users/1", "stackoverflow"), ("https://linkedin.com/company/x", "other")])
    check(spark, contact.code_host_user, [("https://github.com/octo/repo", "octo"), ("github.com/octo", "octo"), ("octo", "octo"), ("https://gitlab.com/octo", None), ("https://github.com/", None)])


def test_dates(spark):
    d = dt.date
    pairs = [("Q3 2019", d(2019, 7, 1)), ("Jan 2020", d(2020, 1, 1)), ("september 2020", d(2020, 9, 1)), ("2018", d(2018, 1, 1)), ("1900", None), ("2020-02-30", None), ("2020-03-04", d(2020, 3, 4)), ("2020-03", d(2020, 3, 1)), ("03/04/2020", d(2020, 3, 4)), ("25/12/2020", d(2020, 12, 25))]
    pairs += [("03/2020", d(2020, 3, 1)), ("March 5, 2021", d(2021, 3, 5)), ("5th Mar 2021", d(2021, 3, 5)), ("2021-01-02T03:04:05Z", d(2021, 1, 2)), ("present", None), ("garbage", None), ("", None), (None, None)]
    check(spark, lambda c: dates.parse_date(c, day()), pairs)
    check(spark, lambda c: dates.parse_date(c, day(), end=True), [("Present", d(2024, 6, 15)), ("till date", d(2024, 6, 15)), ("2020", d(2020, 1, 1))])
    span = lambda c: F.concat_ws("|", *(F.coalesce(dates.parse_range(c, day())[k].cast("string"), F.lit("-")) for k in ("start", "end", "current")))
    check(spark, span, [("Jan 2018 – Mar 2022", "2018-01-01|2022-03-01|false"), ("2018 - Present", "2018-01-01|2024-06-15|true"), ("2018", "2018-01-01|-|false"), (None, "-|-|false")])


def test_durations(spark):
    rows = spark.createDataFrame([("2020-01-31", "2021-03-01", False), ("2020-01-01", None, True), ("2021-01-01", "2020-01-01", False), (None, None, True), ("2020-01-01", None, False)], "s string, e string, c boolean")
    got = rows.select(dates.duration_months(F.col("s").cast("date"), F.col("e").cast("date"), F.col("c"), day()).alias("m")).collect()
    assert [r.m for r in got] == [14, 53, 0, None, None]


def test_places(spark):
    def shown(c):
        p = places.parse_place(c)
        return F.when(p.isNotNull(), F.concat_ws("|", *(F.coalesce(p[k], F.lit("-")) for k in ("city", "state", "country", "country_code"))))

    pairs = [("San Francisco, CA", "San Francisco|California|United States|US"), ("Paris, France", "Paris|-|France|FR"), ("Austin, texas", "Austin|texas|United States|US"), ("Toronto, ON, Canada", "Toronto|ON|Canada|CA"), ("Berlin", "Berlin|-|-|-"), ("Remote", "Remote|-|-|-"), ("X, Y", "X|Y|-|-"), (" ", None), (None, None)]
    check(spark, shown, pairs)
    check(spark, lambda c: places.display(places.parse_place(c)), [("Austin, TX", "Austin, Texas, United States"), ("Remote", "Remote")])


def test_degrees_and_grades(spark):
    check(spark, mapping.degree, [("Master of Science in Computer Science", "master"), ("Ph.D.", "phd"), ("MBA", "mba"), ("Bachelor of Arts", "bachelor"), ("programs ", "master"), ("Weaving", "other"), ("", "unknown"), (None, "unknown")])
    check(spark, mapping.gpa, [("3.9", 3.9), ("3.8/4.0", 3.8), ("5.0", None), ("A", None), ("", None), (None, None)])


def test_skills(spark):
    check(spark, skills.normal_skills, [(["python3", "reactjs", "k8s"], ["Python", "React", "Kubernetes"]), (["Pythn", "python", "weaving loom"], ["Python", "Weaving Loom"]), (["", None], []), (None, [])], "array<string>")
    table = skills.alias_table()
    assert table["scrum"] == "Scrum" and table["vuejs"] == "Vue.js" and table["c++17"] == "C++" and table["java 11"] == "Java" and table["spark"] == "Apache Spark" and table["kafka"] == "Apache Kafka"
    assert len(skills.SKILLS) == 74 and sum(map(len, skills.SKILLS.values())) == 203
    pairs = [("Agile", ["agile methodology", "agile scrum", "scrum"]), ("Angular", ["angularjs", "angular js", "angular2", "angular 2", "angular 12", "angular 14"]), ("Weaving", []), (None, [])]
    check(spark, skills.aliases_of, pairs)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c", max_size=9), st.text(alphabet="ab c", max_size=9))
def test_ratio_is_that_of_the_subsequence_table(a, b):
    x, y = (" ".join(sorted(s.split())) for s in (a, b))
    line = [0] * (len(y) + 1)
    for ch in x:
        line = next_line(line, ch, y)
    want = 100.0 if x == y else 200.0 * line[-1] / (len(x) + len(y))
    assert similarity.ratio(a, b) == pytest.approx(want)


def next_line(line, ch, y):
    out = [0]
    for j, other in enumerate(y, 1):
        out.append(line[j - 1] + 1 if ch == other else max(line[j], out[-1]))
    return out


def test_native_ratio_is_the_same(spark):
    pairs = [("a company", "b company"), ("Acme Corp", "acme corp"), ("data engineer", "engineer data"), ("", "x"), ("abc", "xyz"), ("kubernetes", "kubernets")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.token_sort_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        assert (r.r or 0.0) == pytest.approx(similarity.ratio(r.a, r.b))
    assert similarity.ratio("a company", "b company") == pytest.approx(88.888888, abs=1e-4)


def test_leaders_are_not_passed_on():
    names = ["alpha beta gamma", "alpha beta gamm", "lpha beta gamm", "zzz"]
    assert similarity.leaders([names], [95.0]) == [0, 0, 2, 3]
    assert similarity.leaders([[]], [80.0]) == []


def test_priorities(spark):
    check(spark, dims.priority, [("ats", 0), ("notes", 4), ("fax", 5)])
    check(spark, dims.weight, [("ats", 0.95), ("unknown", 0.5)])
