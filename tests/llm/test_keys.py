"""Keys of every kind come out of every operator as they went in."""

import decimal

import public_tokenizers
import pytest

from tidemark.llm import decontaminate, html_text, rules, simhash
from tidemark.llm.bpe import encode_decode
from tidemark.llm.queries import TOKENIZER

BIG = 2**53 + 1
ITEM = "one two three four five six seven"
KEYS = [
    ("long", [BIG, None, -BIG]),
    ("string", ["9007199254740993", None, "x"]),
    ("decimal(38,2)", [decimal.Decimal("123456789012345678901234567890123456.78"), None, decimal.Decimal("0.01")]),
]


@pytest.mark.parametrize("kind,keys", KEYS)
def test_keys_beside_null(rows, kind, keys):
    docs = rows([(k, ITEM, "en", 1, "x") for k in keys], f"doc_id {kind}, text string, lang string, _text int, _lang string", 1)
    path = public_tokenizers.path(TOKENIZER)
    for got in (
        encode_decode(docs, path),
        encode_decode(docs, path, with_ids=True),
        rules.quality_rules(docs),
        simhash.near_duplicates(docs),
    ):
        assert sorted(map(str, [r.doc_id for r in got.collect()])) == sorted(map(str, keys))
    items = rows([(k, ITEM) for k in keys], f"item_id {kind}, text string")
    found = decontaminate.leaks(docs, items).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in found) == sorted(str((a, b)) for a in keys for b in keys)
    pages = rows([(k, "http://h/", "<p>a", 3) for k in keys], f"page_id {kind}, url string, html string, host int", 1)
    assert sorted(str(r.page_id) for r in html_text.main_text(pages).collect()) == sorted(map(str, keys))


def test_no_items_and_no_documents(rows):
    docs = rows([(BIG, ITEM), (None, None)], "doc_id long, text string")
    none = rows([], "item_id string, text string")
    got = decontaminate.leaks(docs, none)
    assert got.columns == ["doc_id", "item_id", "n_edits", "item_words"] and got.count() == 0
    assert dict(got.dtypes)["item_id"] == "string"
    assert decontaminate.leaks(docs.limit(0), rows([(1, ITEM)], "item_id long, text string")).count() == 0
