"""Sources, the engine end to end, command line, streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tributary.__main__ import main
from tributary.operators import confidence, lookups, mapping, merge, project, validate
from tributary.plans import engine
from tributary.plans.inputs import as_canonical
from tributary.sources import delimited, documents, profiles, prose
from tributary.streaming import upsert

DAY = "2024-06-15"
RECORD = {
    "id": "A-1", "status": "open", "full_name": "jane smith", "emails": ["Jane.Smith@Example.com", "bad"], "phones": "(415) 555-0198; 415-555-0134", "location": "San Francisco, CA",
    "summary": "Builds  things.", "years_of_experience": 7.5, "skills": ["python3", "k8s", "Python"], "languages": "English, spanish",
    "experience": [{"company": "acme corp", "title": "Engineer", "start_date": "2020-01", "end_date": "Present", "technologies": ["reactjs"], "is_current": True}, "junk", {"employer": "Beta", "position": "Analyst", "from": "Jan 2018", "to": "2019-12-31"}],
    "education": [{"institution": "State University", "degree": "Master of Science", "gpa": 3.9, "end_date": "2017"}], "projects": [{"name": "Loom", "stars": 5, "repo_url": "github.com/j/loom"}],
    "certificates": [{"title": "Cert A", "issuer": "Org"}], "social_links": [{"platform": "LinkedIn", "url": "linkedin.com/in/jane"}], "github": "https://github.com/jane",
}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(RECORD))
    (tmp_path / "r.csv").write_text('first_name,last_name,email,phone,location,current_title,current_company,skills,years_experience,linkedin_url\nJane,Smith,jane.smith@example.com,+14155550198,"Austin, TX",Software Engineer,Acme Corp,"Python, Docker",7+,https://linkedin.com/in/jane\n')
    (tmp_path / "n.txt").write_text("Candidate: Jane Smith\nEmail: jane.smith@example.com\nLocation: San Francisco, CA\n8 years of experience with kubernetes. github.com/jane")
    (tmp_path / "cv.txt").write_text("Jane Smith\njane.smith@example.com\n\nSummary\nBuilds things\n\nSkills\nPython, Terraform\n\nExperience\nAcme Corp | Engineer\nJan 2020 - Present\nDid a lot\n\nEducation\nState University\nMaster of Science in Weaving, 2017\n")
    return tmp_path


def test_json_source(spark, files):
    r = documents.read_documents(spark, str(files / "r.json"), F.lit("e")).first()
    assert r.error is None and r.emails == ["Jane.Smith@Example.com", "bad"] and r.phones == ["(415) 555-0198", "415-555-0134"] and r.languages == ["English", "spanish"]
    assert [x.company for x in r.experience] == ["acme corp", "Beta"] and r.experience[0].is_current and r.education[0].gpa_raw == "3.9" and r.projects[0].stars == 5
    assert [(x.platform, x.url) for x in r.social_links] == [("LinkedIn", "linkedin.com/in/jane"), ("github", "https://github.com/jane")]
    assert r.extras == {"external_id": "A-1", "status": "open"} and r.certifications[0].issuing_organization == "Org"


def test_json_errors_and_gaps(spark):
    rows = spark.createDataFrame([("a", "{not json"), ("b", "[1]"), ("c", '{"name": "X"}'), ("d", None)], "k string, doc string")
    out = {r.entity_id: r for r in documents.from_json_rows(rows, F.col("k"), F.col("k"), F.col("doc")).collect()}
    assert "invalid" in out["a"].error and "object" in out["b"].error and out["c"].error is None and out["c"].skills_raw == [] and out["d"].error


def test_delimited_source(spark, files, tmp_path):
    r = delimited.read_delimited(spark, str(files / "r.csv"), F.lit("e")).first()
    assert (r.first_name, r.location_raw, r.skills_raw, r.years_of_experience) == ("Jane", "Austin, TX", ["Python", "Docker"], None)
    assert r.experience[0].company == "Acme Corp" and r.experience[0].is_current and r.social_links[0].platform == "linkedin"
    for name, body in (("semi.csv", "Name;E-Mail\nJo;jo@x.org\n"), ("bom.csv", "﻿name|email\nJo|jo@x.org\n")):
        (tmp_path / name).write_text(body)
        assert delimited.read_delimited(spark, str(tmp_path / name)).first().emails == ["jo@x.org"]
    (tmp_path / "one.csv").write_text("name\nJo\n")
    assert "column" in delimited.read_delimited(spark, str(tmp_path / "one.csv")).first().error
    (tmp_path / "latin.csv").write_bytes("name,email\nJosé,j@x.org\n".encode("latin-1"))
    assert delimited.read_delimited(spark, str(tmp_path / "latin.csv")).first().full_name == "José"


def test_files_of_many_entities(spark, tmp_path):
    (tmp_path / "many.csv").write_text("name,email\n" + "".join(f"P{i},p{i}@x.org\n" for i in range(500)))
    assert delimited.sniffed(spark, str(tmp_path / "many.csv")) == ("UTF-8", ",", False)
    rows = delimited.read_delimited(spark, str(tmp_path / "many.csv"))
    assert rows.select("entity_id").distinct().count() == rows.count() == 500
    (tmp_path / "over.csv").write_text('name,summary\nJo,"one, ""two""\nthree"\nAl,x\n')
    assert delimited.sniffed(spark, str(tmp_path / "over.csv"))[2]
    assert [(r.full_name, r.summary) for r in delimited.read_delimited(spark, str(tmp_path / "over.csv")).orderBy("full_name").collect()] == [("Al", "x"), ("Jo", 'one, "two"\nthree')]
    (tmp_path / "many.jsonl").write_text('{"name": "A"}\n\n{"name": "B"}\n[1]\n')
    found = documents.read_documents(spark, str(tmp_path / "many.jsonl")).collect()
    assert len({r.entity_id for r in found}) == 3 and sorted(r.full_name or "" for r in found) == ["", "A", "B"] and sum(r.error is not None for r in found) == 1


def test_notes_source(spark, files, tmp_path):
    r = prose.read_notes(spark, str(files / "n.txt"), F.lit("e")).first()
    assert (r.full_name, r.location_raw, r.years_of_experience, r.emails) == ("Jane Smith", "San Francisco, CA", 8.0, ["jane.smith@example.com"])
    assert "kubernetes" in r.skills_raw and r.social_links[0].url == "https://github.com/jane"
    (tmp_path / "empty.txt").write_text("  \n")
    assert "empty" in prose.read_notes(spark, str(tmp_path / "empty.txt")).first().error


def test_resume_source(spark, files):
    r = prose.read_resumes(spark, str(files / "cv.txt"), F.lit("e")).first()
    assert (r.full_name, r.summary, r.skills_raw) == ("Jane Smith", "Builds things", ["Python", "Terraform"])
    job, school = r.experience[0], r.education[0]
    assert (job.company, job.title, job.start_raw, job.end_raw, job.is_current, job.description) == ("Acme Corp", "Engineer", "Jan 2020", "Present", True, "Did a lot")
    assert (school.institution, school.degree_raw, school.field_of_study, school.end_raw) == ("State University", "Master of Science in Weaving, 2017", "Weaving, 2017", "2017")


def test_profile_source(spark):
    repos = [{"name": f"r{i}", "language": ["Go", "Rust", "Makefile"][i % 3], "stargazers_count": i % 4, "fork": i == 3, "topics": ["a", "b", "c", "d", "e", "f"], "homepage": "", "html_url": f"https://github.com/o/r{i}"} for i in range(14)] + [{"name": "bare"}]
    rows = [("octo", json.dumps({"name": "Octo Cat", "blog": "cat.org", "twitter_username": "cat", "email": "o@x.org", "followers": 3}), json.dumps(repos), None), ("gone", "null", "[]", "[github] user not found: gone")]
    out = {r.entity_id: r for r in profiles.from_answers(spark.createDataFrame(rows, "login string, profile string, repos string, error string")).collect()}
    r = out["octo"]
    assert r.skills_raw == ["Go", "Rust"] and len(r.projects) == 10 and [p.name for p in r.projects[:3]] == ["r7", "r11", "r2"] and len(r.projects[0].technologies) == 6
    assert [x.url for x in r.social_links] == ["https://github.com/octo", "https://cat.org", "https://twitter.com/cat"] and r.extras["followers"] == "3"
    assert out["gone"].error and out["gone"].social_links == []


def test_service_errors():
    import io
    import urllib.error

    calls = []

    def answer(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, io.BytesIO())
        return io.BytesIO(b'{"login": "x"}')

    assert profiles.fetched("http://s/users/x", "t", answer, lambda s: None) == ({"login": "x"}, None) and len(calls) == 3
    assert "not found" in profiles.service_error(404, {}, "u") and "rate limit" in profiles.service_error(403, {"X-RateLimit-Remaining": "0"}, "u") and "server error" in profiles.service_error(500, {}, "u")
    assert profiles.service_error(200, {}, "u") is None


def test_golden_profile(spark, files):
    out = engine.fuse_files(spark, {"ats": str(files / "r.json")}, as_of=DAY)
    r = out.validated.first()
    assert (r.full_name, r.first_name, r.last_name, r.emails, r.phones) == ("Jane Smith", "Jane", "Smith", ["jane.smith@example.com"], ["+14155550198", "+14155550134"])
    assert [s.canonical_name for s in r.skills] == ["Python", "Kubernetes"] and r.experience[0].technologies == ["React"] and r.education[0].degree == "master" and r.education[0].gpa == 3.9
    assert r.experience[0].end_date is None and r.experience[1].end_date == dt.date(2019, 12, 31) and [x.name for x in r.languages] == ["English", "Spanish"]
    # Six scalars at 0.95 weigh 4.0, eight lists at 0.5 weigh 5.8.
    assert r.confidence.overall_score == pytest.approx(0.6837) and r.confidence.fields["emails"].score == 0.5
    assert r.confidence.high_confidence_fields == ["first_name", "full_name", "last_name", "location", "summary", "years_of_experience"]
    shown = json.loads(out.json.first()["json"])
    assert shown["location"]["display"] == "San Francisco, California, United States" and shown["experience"][0]["duration_months"] == 53 and "headline" not in shown
    assert shown["metadata"]["sources_succeeded"] == ["ats"] and shown["confidence"]["fields"]["full_name"]["score"] == 0.95


def test_all_sources(spark, files):
    given = {"ats": files / "r.json", "csv": files / "r.csv", "resume": files / "cv.txt", "notes": files / "n.txt"}
    out = engine.fuse_files(spark, {k: str(v) for k, v in given.items()}, as_of=DAY)
    r = out.validated.first()
    assert r.sources == ["ats", "csv", "resume", "notes"] and r.location.city == "San Francisco" and [s.canonical_name for s in r.skills][:3] == ["Python", "Kubernetes", "Docker"]
    by = {p.field_name: p for p in r.provenance}
    assert by["full_name"].conflict_resolved is False and len(by["full_name"].candidates) == 4 and r.confidence.fields["full_name"].score == 1.0
    assert by["years_of_experience"].conflict_resolved and r.confidence.fields["years_of_experience"].score == pytest.approx(0.85)
    assert len(r.experience) == 2 and {x.company for x in r.experience} == {"Acme CORP", "Beta"}
    assert out.status.where("succeeded").count() == 4


def test_partial_failure(spark, files, tmp_path):
    (tmp_path / "bad.json").write_text("{")
    out = engine.fuse_files(spark, {"ats": str(tmp_path / "bad.json"), "csv": str(files / "r.csv"), "notes": str(tmp_path / "missing.txt")}, as_of=DAY)
    assert {r.source: r.succeeded for r in out.status.collect()} == {"ats": False, "csv": True, "notes": False}
    assert json.loads(out.json.first()["json"])["metadata"]["sources_failed"] == ["ats", "notes"]
    with pytest.raises(ValueError):
        engine.fuse_files(spark, {"ats": str(tmp_path / "bad.json")})
    with pytest.raises(ValueError):
        engine.fuse_files(spark, {})
    with pytest.raises(ValueError):
        engine.reader("fax")


def struct_rows(spark, rows, field, kind):
    df = spark.createDataFrame([(e, s, v) for e, s, v in rows], f"e string, s string, v {kind}")
    parts = [as_canonical(df.where(F.col("s") == s), s, F.col("e"), **{field: F.col("v")}) for s in dict.fromkeys(r[1] for r in rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return merge.merge_records(out)


def test_merge_enriches_alike_entries(spark):
    job = lambda company, title, **k: {"company": company, "title": title, "is_current": k.get("current", False), "description": k.get("description"), "start_date": None, "end_date": k.get("end"), "responsibilities": [], "technologies": k.get("tech", []), "achievements": []}
    from tributary.sources.schema import EXPERIENCE

    kind = f"array<{EXPERIENCE}>"
    full = lambda j: j | {"location": None}
    rows = [("x", "csv", [full(job("Company A", "Engineer", current=True, tech=["b"]))]), ("x", "resume", [full(job("company b", "Engineer", description="d", end=dt.date(2020, 1, 1), tech=["a"])), full(job("Other", "Cook"))])]
    r = struct_rows(spark, rows, "experience", kind).first()
    assert [x.company for x in r.experience] == ["Company A", "Other"]
    first = r.experience[0]
    assert first.description == "d" and first.end_date == dt.date(2020, 1, 1) and first.is_current and first.technologies == ["a", "b"]


def test_merge_of_a_hot_key_and_empty_tables(spark):
    df = spark.range(3000).select(F.lit("hot").alias("e"), F.concat(F.lit("n"), F.col("id")).alias("n"))
    hot = merge.merge_records(as_canonical(df, "ats", F.col("e"), full_name=F.col("n")))
    assert hot.count() == 1 and hot.first().full_name == merge.merge_records(as_canonical(df.repartition(7), "ats", F.col("e"), full_name=F.col("n"))).first().full_name
    empty = as_canonical(df.limit(0), "ats", F.col("e"))
    assert confidence.with_confidence(confidence.with_provenance(merge.merge_records(empty))).count() == 0
    bare = confidence.with_confidence(confidence.with_provenance(merge.merge_records(as_canonical(df.limit(1), "fax", F.col("e"))))).first()
    assert bare.confidence.fields["full_name"].score == 0.0 and bare.sources == ["fax"]


def test_validation_rules(spark):
    df = spark.createDataFrame([("x",)], "e string")
    school = F.expr("array(named_struct('institution', 'U', 'degree', 'other', 'field_of_study', string(null), 'start_date', date'2020-01-01', 'end_date', date'2019-01-01', 'gpa', 5.0D, 'honors', array()))")
    checked = validate.with_findings(as_canonical(df, "ats", F.col("e"), education=school, first_name=F.lit("A")), DAY)
    found = {(r.severity, r.field) for r in validate.findings_rows(checked).collect()}
    assert found == {("error", "full_name"), ("warning", "contact"), ("error", "education[0] (U).dates"), ("error", "education[0].gpa"), ("warning", "summary"), ("warning", "skills"), ("warning", "experience")}
    strict = validate.summary(validate.with_findings(as_canonical(df, "ats", F.col("e")), DAY, strict=True)).first()
    assert strict.warnings == 0 and strict.errors == 6 and not strict.is_valid


def test_output_configuration(tmp_path):
    (tmp_path / "c.json").write_text('{"output_fields": ["emails", "full_name", "odd"], "include_provenance": false, "flatten_arrays": true}')
    c = project.OutputConfig.read(tmp_path / "c.json")
    assert c.shown == ["candidate_id", "full_name", "emails"] and c.null_handling == "omit"
    assert project.OutputConfig.of({"output_fields": []}).output_fields == project.DEFAULT
    (tmp_path / "bad.json").write_text("{")
    for name in ("bad.json", "missing.json"):
        with pytest.raises(ValueError):
            project.OutputConfig.read(tmp_path / name)


def test_confidence_threshold(spark, files):
    out = engine.fuse_files(spark, {"ats": str(files / "r.json")}, project.OutputConfig(confidence_threshold=0.6), as_of=DAY)
    shown = json.loads(out.json.first()["json"])
    assert "emails" not in shown and shown["full_name"] == "Jane Smith"


def test_lookups(spark):
    dim = lookups.dictionary(spark, {"python": "Python", "kubernetes": "Kubernetes", "go": "Go"})
    keys = spark.createDataFrame([("Pythn",), ("pythn",), ("kubernets",), ("go",), ("zebra",), (None,)], "key string")
    assert {(r.key, r.name) for r in lookups.likest(keys, dim).collect()} == {("pythn", "Python"), ("kubernets", "Kubernetes")}
    texts = spark.createDataFrame([(1, "Go, go Python-kubernetes"), (2, "gopher"), (3, None), (4, "")], "doc_id long, text string")
    assert {tuple(r) for r in lookups.terms_by_join(texts, dim).collect()} == {(1, "go"), (1, "python"), (1, "kubernetes")}
    assert lookups.by_alias(keys, F.col("key"), dim).where("name = 'Go'").count() == 1


def test_composed_characters(spark):
    from tributary.functions.text import nfc

    assert spark.createDataFrame([("é",)], "t string").select(nfc(F.col("t")).alias("t")).first().t == "é"


def test_command_line(files, spark, capsys):
    assert main(["transform", "--ats", str(files / "r.json"), "--output", str(files / "out" / "p.json")]) == 0
    assert json.loads((files / "out" / "p.json").read_text())["full_name"] == "Jane Smith"
    assert main(["transform"]) == 1 and main(["sources"]) == 0
    (files / "x.json").write_text('{"emails": ["jo@x.org"]}')
    assert main(["transform", "--ats", str(files / "x.json"), "--strict"]) == 2


def test_write(spark, files):
    out = engine.fuse_files(spark, {"csv": str(files / "r.csv")}, as_of=DAY)
    out.write(str(files / "lines"))
    assert json.loads(spark.read.text(str(files / "lines")).first().value)["first_name"] == "Jane"


def test_streaming_upsert(spark, tmp_path):
    schema = "k string, doc string"
    (tmp_path / "in").mkdir()
    seen = {}

    def write(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def each(fused, number):
        seen[number] = {r.entity_id: r.full_name for r in fused.merged.select("entity_id", "full_name").collect()}

    def run():
        rows = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = upsert.upsert(documents.from_json_rows(rows, F.col("k"), F.col("k"), F.col("doc")), str(tmp_path / "state"), str(tmp_path / "check"), each, as_of=DAY)
        q.processAllAvailable()
        q.stop()

    write("a", [("1", '{"name": "Ann Lee"}'), ("2", '{"name": "Bo Ek"}')])
    run()
    write("b", [("1", '{"name": "Anna Lee"}')])
    run()
    assert seen == {0: {"1": "Ann Lee", "2": "Bo Ek"}, 1: {"1": "Anna Lee"}}
    assert mapping.map_canonical(upsert.latest(spark, str(tmp_path / "state")), DAY).count() == 2


def multipart(**files):
    edge = "edge42"
    parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{n}"' + (f'; filename="{n}.txt"' if isinstance(v, bytes) else "") + "\r\n\r\n" + (v.decode() if isinstance(v, bytes) else v) + "\r\n" for n, v in files.items()]
    return f"multipart/form-data; boundary={edge}", ("".join(parts) + f"--{edge}--\r\n").encode()


def test_service(spark, files):
    import threading
    import urllib.error
    import urllib.request

    from tributary.serve import server

    web = server(spark, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{web.server_port}"

    def post(**given):
        kind, body = multipart(**given)
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{top}/api/v1/transform", body, {"Content-Type": kind})) as answer:
                return answer.status, json.loads(answer.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert json.loads(urllib.request.urlopen(f"{top}/health").read())["status"] == "healthy"
    status, out = post(ats_file=json.dumps(RECORD).encode(), config_file=b'{"output_fields": ["full_name"], "include_metadata": false, "include_confidence": false}')
    assert status == 200 and set(out) == {"candidate_id", "full_name"}
    assert post(odd="x")[0] == 400 and post(ats_file=b"{")[0] == 400
    web.shutdown()


def test_users_of_profiles():
    assert [profiles.user_of(x) for x in ("https://github.com/octo/r", "github.com/octo", "octo", "https://gitlab.com/octo", "https://github.com/")] == ["octo", "octo", "octo", None, None]
