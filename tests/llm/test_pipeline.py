import corpus_pipeline


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_line_stage_keeps_what_is_left_of_a_document(spark):
    shared = "\n".join(" ".join(f"shared{k}x{i}" for i in range(30)) for k in range(10))
    own, late = (" ".join(f"{w}{i}" for i in range(60)) for w in ("own", "late"))
    rows = [(1, shared), (2, f"{shared}\n{own}"), (3, f"{own}\n{late}"), (4, shared), (5, " \n"), (6, None), (7, "two words")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs(spark, rows), "").collect()}
    # 2 loses 300 of 360 words and stays; so its line, the earliest of its kind, isn't lost when 3 gives up its own; 4 has no word left
    assert got == {1: (shared, len(shared)), 2: (own, len(own)), 3: (late, len(late)), 5: (" \n", 2), 6: (None, None), 7: ("two words", 9)}


def test_near_duplicate_stage_keeps_one_row_of_repeated_ones(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (4, c), (4, f"{c} more"), (5, None), (5, None), (None, c), (None, c)]
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), "").collect())
    # rows without an id are none another's copies
    assert got == [(0, c), (0, c), (1, a), (3, b), (4, c), (4, f"{c} more"), (5, "")]


def test_line_stage_removes_copies_of_lines_without_spaces(spark):
    line = "这一段文字没有任何空格但是在许多网页上一再出现并且应当只留下一份"
    rows = [(1, f"{line}\n-"), (2, f"a b\n{line}\n{'-' * 40}\nHome"), (3, f"Home\n{line[:10]}\n{'-' * 40}"), (4, f"{line[:10]}\n{line[1:]}")]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs(spark, rows), "").collect()}
    # short lines and rules stay
    assert got == {1: rows[0][1], 2: f"a b\n{'-' * 40}\nHome", 3: rows[2][1], 4: rows[3][1]}
