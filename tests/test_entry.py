from graphloom.operators.textlint import markdown_blocks


def test_entry_and_oracle_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert sorted(e.entry(spark).columns) == ["n", "s"]


def test_markdown_blocks_skip_fences_and_front_matter():
    # A fence ends at the next fence of the same mark, however long that is.
    text = "---\nx: 1\n---\n# H\n\nOne\ntwo\n\n- item\n\n````\n~~~\ncode\n```\nlast"
    assert [(b[2], b[3]) for b in markdown_blocks(text)] == [("One two", False), ("item", True), ("last", False)]
