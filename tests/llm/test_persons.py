"""Who a name means: people of one last name, by titles, within a document and across documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracewright.llm import pii


def rewritten(spark, texts: list[str]) -> list[str]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.replaced(docs, "key").collect()
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_titles_tell_two_people_of_one_last_name_apart(spark):
    (got,) = rewritten(spark, ["Mr. John Smith met Mrs. Mary Smith. Later Mrs. Smith left; Mr. Smith stayed."])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\. Later Mrs\. (\w+) left; Mr\. (\w+) stayed\.", got)
    assert m and m[2] == m[6] != m[4] == m[5]
    assert m[1] in pii._FIRST["m"] and m[3] in pii._FIRST["f"]


def test_a_last_name_that_fits_two_people_is_neither(spark):
    (got,) = rewritten(spark, ["Mr. John Smith and Mr. Paul Smith came. Mr. Smith spoke, Smith left."])
    m = re.fullmatch(r"Mr\. \w+ (\w+) and Mr\. \w+ (\w+) came\. Mr\. (\w+) spoke, (\w+) left\.", got)
    assert m and len({m[1], m[2], m[3]}) == 3 and m[3] == m[4]


def test_a_neutral_title_joins_the_one_who_fits(spark):
    got = rewritten(spark, ["Dr. Jane Roe came; Ms. Roe spoke.", "Dr. Brown came; Ms. Brown spoke.", "Dr. Brown, Mr. Brown and Ms. Brown."])
    a = re.fullmatch(r"Dr\. \w+ (\w+) came; Ms\. (\w+) spoke\.", got[0])
    b = re.fullmatch(r"Dr\. (\w+) came; Ms\. (\w+) spoke\.", got[1])
    c = re.fullmatch(r"Dr\. (\w+), Mr\. (\w+) and Ms\. (\w+)\.", got[2])
    assert a[1] == a[2] and b[1] == b[2] == c[3] and len({c[1], c[2], c[3]}) == 3


def test_one_last_name_of_two_genders_in_two_documents(spark):
    got = rewritten(spark, ["Ms. Brown wrote.", "Mr. Brown wrote.", "Then MS. went; Ms. Brown stayed."])
    ms, mr, again = (re.search(r"(?:Ms|Mr)\. (\w+) ", t)[1] for t in got)
    assert ms == again != mr and "Brown" not in "".join(got)


def _meant(name: str, gender: str | None, titled: list[tuple[str, str | None]]) -> str:
    """The rule of the module, person by person."""
    full = {}
    for n, g in titled:
        if " " in n:
            full.setdefault(n, set()).update({g} - {None})
    full = {n: (g.pop() if len(g) == 1 else None) for n, g in full.items()}
    fits = [n for n, g in full.items() if n.endswith(" " + name) and (gender is None or g is None or g == gender)]
    sure = [n for n in fits if gender and full[n] == gender]
    if len(fits) == 1:
        return fits[0]
    if len(sure) == 1:
        return sure[0]
    alone = {g for n, g in titled if n == name} - {None}
    own = gender or (alone.pop() if len(alone) == 1 else None)
    return name + (f"~{own}" if own else "")


def test_persons_against_brute_force(spark):
    import itertools

    titles = {"Mr": "m", "Mrs": "f", "Dr": None}
    names = ["Smith", "John Smith", "Mary Smith"]
    said = [f"{t} {n}" for t in titles for n in names]
    docs = [list(c) for k in (1, 2, 3) for c in itertools.combinations(said, k)]
    rows = spark.createDataFrame(list(enumerate(docs)), "k int, found array<string>")
    value = F.transform("found", lambda m: pii.canonical(F.lit("name"), m, pii.people_of(F.col("found"))))
    for r in rows.select("k", value.alias("v")).collect():
        titled = [(m.split(" ", 1)[1].lower(), titles[m.split(" ")[0]]) for m in docs[r["k"]]]
        assert r["v"] == [n if " " in n else _meant(n, g, titled) for n, g in titled], docs[r["k"]]
