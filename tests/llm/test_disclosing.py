"""Terms that give a protected value away, from the first document that holds it."""

from waypath.llm import pii


def test_terms_of_single_values(spark):
    long = "x" * 230
    rows = [(i, f"some plain words about nothing {i % 7} and more of them") for i in range(900)]
    rows += [(1000, "some words zanzibar mail ann@ex.org about more"), (1001, f"quokka {long} and more mail bob@ex.org of them"), (1002, "mail eve@ex.org some words"), (1003, "mail eve@ex.org and more"), (1004, "some plain mail"), (1005, "some plain mail")]
    rows += [(2000 + i, "some plain zebra") for i in range(2)] + [(3000, "some zebra mail dan@ex.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.terms] for r in pii.find_personal_data(docs).where("terms is not null").collect()}
    assert got == {1000: ["zanzibar"], 1001: ["quokka", long]}  # "mail", "some" and "zebra" stand without the value more often
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).where("doc_id >= 1000").collect()}
    assert clean[1000] == "some words  mail <email> about more" and clean[3000] == "some zebra mail <email>"
