"""Short and partly copied texts lose their repeated lines in the pipeline; copies of whole texts go as copies."""

import corpus_pipeline as P
from conftest import frame

A = "alpha writes the first of all the lines that stand here"
B = "bravo follows with something that nobody has said before"
C = "charlie closes the passage and then walks off to the harbour"
D = "delta only counts the boxes on the long wooden pier"
OWN = ["echo has a line of its own about weather over hills", "foxtrot speaks of nothing but old bridges and their stones"]


def test_repeated_lines_go_and_copies_stay_copies(spark):
    rows = [(1, "\n".join([A, B, C, D]), "s"), (2, A, "s"), (3, "\n".join([A, B, OWN[0]]), "s"), (4, "\n".join([A, B, C, *OWN[1:], D]), "s"),
            (5, "\n".join([A, B, C, D]), "s"), (6, "\n".join([A, B, OWN[0]]), "s"), (7, "\n".join([A, B, OWN[0]]), "s"), (8, C, "s"), (None, D, "s")]
    lined = P.drop_lines(spark, frame(spark, rows).repartition(3), "")
    got = {r.doc_id: r.text for r in lined.collect()}
    assert got == {1: rows[0][1], 2: "", 3: OWN[0], 4: OWN[1], 5: rows[0][1], 6: OWN[0], 7: OWN[0], 8: "", None: ""}
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    left = P.drop_near_duplicates(spark, lined, "")
    lines = [x for r in left.collect() for x in r.text.split("\n") if x]
    assert sorted(lines) == sorted([A, B, C, D, *OWN])
