"""Members that get their profiles in different rounds still meet in the cells of what their pivot lacks."""

from lexmill.llm import jaccard


def test_added_cells_of_all_rounds(spark):
    frame = lambda rows: spark.createDataFrame(rows, "pivot long, node long, n long, u long, added boolean")
    plain = frame([(1, 10, 100, 0, False), (1, 11, 100, 0, False)])
    found = lambda cells: sorted((r.pivot, r.node) for r in cells.where("added").collect())
    # Round 0: one member has shingle 7 beyond its pivot, two have 8.
    cells, held = jaccard.with_added(plain, None, frame([(7, 10, 100, 0, True), (8, 10, 100, 0, True), (8, 12, 90, 0, True)]))
    assert found(cells) == [(8, 10), (8, 12)]
    # Member 12 leaves cell 8. Round 1: a member with both is profiled.
    cells = cells.where("node != 12")
    cells, held = jaccard.with_added(cells, held, frame([(7, 11, 100, 0, True), (8, 11, 100, 0, True), (9, 11, 100, 0, True)]))
    assert found(cells) == [(7, 10), (7, 11), (8, 10), (8, 11), (8, 12)]
    # Round 2: nothing new, nothing changes; a last entry meets one of round 1.
    cells, held = jaccard.with_added(cells, held, frame([]))
    assert found(cells) == [(7, 10), (7, 11), (8, 10), (8, 11), (8, 12)]
    cells, held = jaccard.with_added(cells, held, frame([(9, 13, 95, 0, True)]))
    assert found(cells) == [(7, 10), (7, 11), (8, 10), (8, 11), (8, 12), (9, 11), (9, 13)]
    assert cells.where("not added").count() == 2 and held.count() == 7
