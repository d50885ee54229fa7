"""Re-parameterised items whose names begin sentences and lines, stand in quotes or whose numbers are words."""

import pytest

from auctionstream.llm import decontamination
from llm_rows import prose

BOX = "A box holds 12 pens. Peter takes 3 of them. Maria adds 4 more. How many pens are left?"
TOM = "Tom has 5 apples. Tom gives 2 to Ann. How many does Tom keep?"
CASES = [
    (BOX, "A box holds 40 pens. Olga takes 7 of them. Sven adds 9 more. How many pens are left?", "other values"),
    (BOX, "A box holds 40 pens.\nOlga takes seven of them.\n\nSven adds nine more.  How many pens are left?", "other values"),
    (TOM, "Kim has 8 apples. Kim gives 3 to Lee. How many does Kim keep?", "other values"),
    (TOM, "Kim has twenty-one apples. Kim gives three to Lee. How many does Kim keep?", "other values"),
    (TOM, "tom has 5 apples. tom gives 2 to ann. how many does tom keep?", "same"),
    (TOM, TOM, "same"),
    ('The old clerk said "Peter owns 12 carts" and (Maria) nodded at him', 'The old clerk said "Olga owns 9 carts" and (Kim) nodded at him', "other values"),
    ("now the tall guard walks nine miles past green hills", "now the tall guard. Walks 7 miles past green hills", "other values"),
]


@pytest.mark.parametrize("item, text, kind", CASES)
def test_names_and_numbers_of_other_items(spark, frame, item, text, kind):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"{prose(1, 30)}\n{text}\n{prose(2, 30)}", "a"), (2, text, "a"), (3, prose(3, 80), "a")]
    found = decontamination.contaminated(frame(rows), bench).collect()
    assert sorted((r.doc_id, r.kind) for r in found) == [(1, kind), (2, kind)]


def test_names_must_stay_the_same(spark, frame):
    bench = spark.createDataFrame([(1, TOM)], "item_id long, text string")
    other = "Kim has 8 apples. Lee gives 3 to Pat. How many does Sue keep?"
    assert decontamination.contaminated(frame([(1, other, "a")]), bench).count() == 0


def test_other_words_with_a_capital_are_no_names(spark, frame):
    bench = spark.createDataFrame([(1, "now the tall guard walks over wet grass past green hills")], "item_id long, text string")
    assert decontamination.contaminated(frame([(1, "now the tall guard Sings over wet grass past green hills", "a")]), bench).count() == 0
