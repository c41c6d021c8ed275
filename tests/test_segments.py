"""The block grid, groups of blocks and spans."""

from hypothesis import given
from hypothesis import strategies as st

from tidemark.operators import segments

TEXT = "# Täg\n\nfirst line\nsecond\n- item\n  more\n- next\n| a | b |\n| - | - |\n> said\n\n```py\nx = 1\n\n# no heading\n```\nlast"


def test_kinds():
    grid = segments.scan(TEXT)
    assert [b[1] for b in grid] == ["heading", "paragraph", "list_item", "list_item", "table", "quote", "code", "paragraph"]
    assert all(TEXT.encode()[b[2]:b[3]].decode() == b[4] for b in grid)


def test_open_fence_runs_to_the_end():
    assert [b[1] for b in segments.scan("~~~\na\n```\n\nb")] == ["code"]


@given(st.text(alphabet="ab#|>`~-1. \n\té😀 "))
def test_grid_is_a_partition(text):
    grid, raw = segments.scan(text), text.encode()
    at, ink = 0, ""
    for _, _, start, end, body in grid:
        assert at <= start < end and raw[start:end].decode() == body and not raw[at:start].decode().strip()
        at, ink = end, ink + "".join(body.split())
    assert ink == "".join(text.split())


def test_groups_are_honoured_in_order(spark):
    docs = spark.createDataFrame([(1, "a\n\nb\n\nc\n\nd"), (2, None), (3, " ")], "doc_id int, text string")
    grid = segments.blocks(docs)
    groups = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 0, 1), (1, 0, 2, 9), (1, 0, 3, 2), (1, 0, 2, 3), (2, 0, 0, 0)], "doc_id int, window int, first_block int, last_block int")
    judged = segments.accepted(groups, grid)
    got = {(r.doc_id, r.first_block, r.last_block): r.reason for r in judged.collect()}
    assert got == {(1, 0, 1): None, (1, 1, 2): "overlaps", (1, 2, 9): "not_offered", (1, 3, 2): "backwards", (1, 2, 3): None, (2, 0, 0): "not_offered"}
    assert sorted((r.first_block, r.text) for r in segments.spans(docs, grid, judged).collect()) == [(0, "a\n\nb"), (2, "c\n\nd")]


def test_blocks_are_handed_on_in_pieces():
    """A batch of many texts does not become one batch of all their blocks; each block comes once, in order."""
    import pyarrow as pa

    texts = [None, "", *(f"# a{k}\n\nb ü\n\n- c{k}" for k in range(500)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "_text"])
    out = list(segments.grid_batches([batch], 100))
    assert len(out) > 30 and max(b.num_rows for b in out) < 40
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(n, *x) for n, t in enumerate(texts) for x in segments.scan(t or "")]
