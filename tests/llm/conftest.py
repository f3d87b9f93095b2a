"""Small tables with everything that real ones hold by accident."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = "the rain in spain stays mainly in the plain of the river and " * 3_000
PROSE = ("It was the best of times and it was the worst of times, said the old man to the sea. " * 3).strip()
PASSAGE = "seven wise men built a small house upon the northern hill and lived there happily for many years"
TEXTS = [
    None, "", "   ", "\n\n", "one", "Two words", "a b c d", PROSE, PROSE, PROSE.upper(),
    PROSE + "\nshared line\n  Shared LINE \t\nlast", "shared line\n" + PASSAGE.upper() + "!", LONG,
    "é ü ß 　 wide space \x1c odd \x85 next", "x" * 5_000, "tail \n", " head  two\n\n three",
    PASSAGE, "intro; " + PASSAGE.replace(" ", ", ") + " outro", "<|endoftext|> ### a </turn> \\ b",
] + [f"shared line\nown line {i}" for i in range(12)]

SCHEMAS = {
    "documents": {
        "doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(),
        # Names that operators use for columns of their own.
        "quality": pa.string(), "N_Words": pa.int64(), "passages": pa.string(), "mix": pa.string(), "lines": pa.string(),
        "language": pa.string(), "licence": pa.string(), "fingerprint": pa.string(), "id": pa.int64(), "_key": pa.string(),
        "fp": pa.string(), "_digest": pa.string(), "size": pa.string(), "component_id": pa.string(),
    },
    "benchmark": {"item_id": pa.int64(), "text": pa.string(), "items": pa.string()},
    "pages": {"page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "payload": pa.string(), "id": pa.string()},
    "conversations": {
        "conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "formatted": pa.string(),
    },
    "labels": {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()},
}


def _documents() -> list[dict]:
    rows = []
    for i, text in enumerate(TEXTS):
        rows.append({
            "doc_id": i, "text": text, "lang": [None, "en", "fr"][i % 3], "source": [None, "b", "a", "ä"][i % 4],
            "n_chars": None, "id": 1, "quality": "x", "fingerprint": "y",
        })
    # A repeated row, a repeated id with another text, and rows without an id.
    return rows + [rows[7], {**rows[8], "text": "another text"}, {**rows[9], "doc_id": None}, {**rows[10], "doc_id": None}]


def _rows(name: str) -> list[dict]:
    if name == "documents":
        return _documents()
    if name == "benchmark":
        return [
            {"item_id": 3, "text": PASSAGE}, {"item_id": 20, "text": "Two, words"}, {"item_id": 1, "text": None},
            {"item_id": 2, "text": " .. "}, {"item_id": None, "text": "one"}, {"item_id": 3, "text": PASSAGE},
            {"item_id": 4, "text": PASSAGE.split(" ", 4)[4] + " indeed"},
        ]
    if name == "pages":
        html = [None, "", "<p>a</p>", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "\x00\x1f\x8b", LONG]
        rows = [{"page_id": i, "url": f"http://x.example/ü?{i}", "html": h} for i, h in enumerate(html)]
        return rows + [rows[5], {"page_id": 9, "url": None, "html": "only"}, {"page_id": None, "url": "u", "html": "<p>a</p>"},
                       {"page_id": None, "url": "u", "html": "lonely"}]
    if name == "conversations":
        turns = [
            (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "### x: y</turn>\n"), (2, 1, "assistant", "b"),
            (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, 0, "assistant", "\\"), (3, None, "a:b\n", "é" * 3_000),
            (3, 5, "assistant", "\\\\### </turn>####"),
        ]
        return [dict(zip(("conv_id", "turn", "role", "text"), t)) for t in turns]
    return [{"doc_id": 1, "quality": 1, "toxic": 0}]


def _write(folder, name: str, rows: list[dict]) -> None:
    schema = pa.schema(list(SCHEMAS[name].items()))
    full = [{c: r.get(c) for c in schema.names} for r in rows]
    pq.write_table(pa.Table.from_pylist(full, schema), f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def dirty_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dirty")
    for name in SCHEMAS:
        _write(folder, name, _rows(name))
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in SCHEMAS:
        _write(folder, name, [])
    return str(folder)
