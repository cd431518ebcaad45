import pytest

from factweave.llm.leaks import Items, common_places, find_leaks, remove_leaks, tokens

ITEM = "In 2016 the ebony ferry carried 8,496 foot passengers, 67753 bicycles and 10 hearses out of Sodronvik. Auditor B. Zamufox of Favodel Trust found that 72456 vouchers from the yarrow ledger carried the stamp of Badrat although only 75,423 had been issued there."
TWIN = "In 1999 the cobalt ferry carried 1,200 foot passengers, 43211 bicycles and 99 hearses out of Mulopord. Auditor K. Resunil of Vanobek Mills found that 11873 vouchers from the garnet ledger carried the stamp of Holtrix although only 21,004 had been issued there."
FILL = "The committee heard nine views on the budget speech and adjourned the item until the next meeting of the board. "
DOCS = [
    (1, FILL + ITEM + " " + FILL, "x"),
    (2, FILL + ITEM.upper().replace(" ", "\n").replace("8,496", "8496"), "x"),
    (3, FILL + ITEM[:101] + " " + FILL * 3 + ITEM[150:] + FILL, "x"),
    (4, FILL + ITEM.replace("carried", "bore").replace("found that", "saw").replace("Zamufox", "Zamufpx") + FILL, "x"),
    (5, FILL * 2 + TWIN.replace("1999", "1998").replace("Mulopord", "Kansdrel").replace("Resunil", "Obertal").replace("Vanobek", "Sirikot").replace("11873", "90001").replace("43211", "818").replace("21,004", "7,777").replace("garnet", "olive").replace("cobalt", "umber").replace("Holtrix", "Jandrop"), None),
    (6, FILL + 'A reader wrote: "carried the stamp of Badrat" and left it there.', "x"),
    (7, "", "x"), (8, None, "x"), (9, "12 13 14", "x"), (10, FILL * 3000 + ITEM, "x"), (1, FILL + ITEM, "again"),
]


def leaks(spark, docs=DOCS, items=None, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items or [(77, ITEM, "s"), (78, TWIN, "s"), (79, None, "s"), (80, "", "s"), (None, ITEM, "s")], "item_id long, text string, doc_id string")
    return d, find_leaks(d, b, **kw)


def test_copies_parts_and_edits(spark):
    _, found = leaks(spark)
    rows = found.collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 77), (1, 77), (2, 77), (3, 77), (4, 77), (10, 77)]
    for r in rows:
        assert r.matched >= r.item_words / 3 and 1 <= len(r.spans) <= 2
    text = {d: t for d, t, _ in DOCS[:-1]}
    spans = next(r.spans for r in rows if r.doc_id == 2)
    assert "SODRONVIK" in text[2][spans[0].start : spans[0].stop]
    assert max(len(r.spans) for r in rows if r.doc_id == 3) == 2


def town(k):
    return f"The clerk in Town{chr(97 + k % 26)}{k} of Shire{k} wrote {7000 + k} letters to Lord Hamlet{k} and kept {100 + k} copies of each in the old hall."


@pytest.mark.parametrize("few", [True, False])
def test_blocks_give_the_same(spark, few):
    items = [(77, ITEM, "s"), (78, TWIN, "s"), (79, "the small boat came back to the shore before the storm and the people on the shore were glad to see it again", "s")]
    items += [(100 + k, town(k % 40), "s") for k in range(7 if few else 60)]
    docs = [*DOCS, (20, FILL + items[2][1] + FILL, "x"), *[(30 + k, FILL + town(k) + FILL, "x") for k in range(0, 40, 6)]]
    key = lambda df: sorted((r.doc_id, r.item_id, r.matched, str(r.spans)) for r in df.collect())
    size = sum(len(t) for _, t, _ in items)
    want = key(leaks(spark, docs=docs, items=items)[1])
    assert {78, 79, 77} & {i for _, i, _, _ in want} == {77, 79} and len(want) > (8 if few else 14)
    for blocks in (2, 4, 8, 60):
        assert key(leaks(spark, docs=docs, items=items, block_chars=size / blocks)[1]) == want


def test_removal(spark):
    docs, found = leaks(spark)
    clean = {(r.doc_id, r.item_id): r.text for r in remove_leaks(docs, found).collect()}
    assert "Sodronvik" not in clean[1, "x"] and FILL in clean[1, "x"] and clean[6, "x"] == DOCS[5][1] and clean[8, "x"] is None
    assert remove_leaks(docs, found, whole=True).count() == 5


def test_removal_of_further_copies(spark):
    docs, found = leaks(spark, docs=[(1, FILL + ITEM + " " + FILL * 3 + ITEM + " " + ITEM + " " + FILL * 3 + ITEM[150:], "x")])
    clean = remove_leaks(docs, found).first().text
    assert not any(w in clean for w in ("Sodronvik", "ferry", "Zamufox", "72456", "Badrat")) and clean.count(FILL.strip()) == 7
    assert [r.matched for r in found.collect()] == [len(tokens(ITEM))]


def test_items_that_share_a_passage(spark):
    docs = [d for d in DOCS[:7] if d[0] != 5]  # a text of the same pattern, whose words are rare among these items
    asked = ["How many bicycles crossed?", "Who audited the ledger?", "Which year was it?", "Where was the stamp issued?", "Name the trust."]
    items = [(k, f"{ITEM} {q}", "s") for k, q in enumerate(asked)] + [(k, ITEM, "s") for k in range(10, 13)]
    items += [(100 + k, f"The clerk in town{k}x of shire{k}x wrote {7000 + k} letters to lord{k}x and kept {100 + k} copies of each.", "s") for k in range(60)]
    key = lambda df: sorted((r.doc_id, r.item_id, r.matched) for r in df.collect())
    whole = key(leaks(spark, docs=docs, items=items)[1])
    assert {(d, i) for d, i, _ in whole} == {(d, i) for d in (1, 2, 3, 4) for i in (*range(5), *range(10, 13))}
    assert whole == key(leaks(spark, docs=docs, items=items, block_chars=2000)[1])


def test_items_without_names_go_by_their_ngrams(spark):
    item = "the small boat came back to the shore before the storm and the people on the shore were glad to see it again"
    docs = [(1, FILL + item + ". " + FILL, "x"), (2, FILL * 2 + "the boat and the people came to the shore", "x")]
    assert [(r.doc_id, r.item_id) for r in leaks(spark, docs=docs, items=[(5, item, "s")])[1].collect()] == [(1, 5)]


def test_empty_tables(spark):
    assert leaks(spark, docs=[])[1].count() == 0
    assert leaks(spark, items=[(1, None, "s")])[1].count() == 0


def test_tokens_and_subsequence():
    assert tokens("Ébène 24,835 and 24835; 1 234.50 ship-\nment") == ["ebene", "24835", "and", "24835", "1234.50", "shipment"]
    items = Items([(1, "a b c d e")])
    ids = [items.vocab[w] for w in "a x b d c e".replace("x", "a").split()]
    assert len(common_places(ids, 0, len(ids), items.places[1])) == 4
