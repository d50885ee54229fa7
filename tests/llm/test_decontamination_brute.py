"""Decontamination against all windows of every item at all places of every document, in plain Python."""

import itertools
import random
from collections import defaultdict

import pytest
import regex

from auctionstream.llm import decontamination as d

LITERALS = "box holds takes more pens left over wet grass river stone bread train road tall old wide carts apples does keep miles".split()
NAMES = ["Peter", "Maria", "Kim", "Olga", "Ann"]
TENS = "|".join(d.TENS_IN_WORDS)
ALL_NUMBERS = {*d.NUMBER_WORDS, *(t + u for t in d.TENS_IN_WORDS for u in d.UNITS_IN_WORDS)}


def marked(text):
    text = regex.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text or "")
    text = regex.sub(r"([0-9])(?=\p{L})", r"\1 ", text)
    text = regex.sub(rf"(?i)\b({TENS})-(?=(?:{'|'.join(d.UNITS_IN_WORDS)})\b)", r"\1", text)
    out, number_before = [], False
    for word in regex.findall(r"[\p{L}\p{N}\p{M}]+", text):
        low = word.lower()
        number = low[0] in "0123456789" or low in ALL_NUMBERS
        if number:
            kind = "number"
        elif number_before and word in d.UNITS:
            kind = "unit"
        elif regex.match(r"\p{Lu}", word) and low not in d.NO_NAMES:
            kind = "name"
        else:
            kind = None
        out.append((kind, low))
        number_before = number
    return out


def template(window):
    return tuple(kind or word for kind, word in window)


def n_slots(window):
    return sum(kind is not None for kind, _ in window)


def item_forms(text):
    """Template to (place, slots of the item), and the number of its different windows."""
    words, first = marked(text), {}
    for j in range(len(words) - 4):
        own = words[j : j + 5]
        if n_slots(own) <= 3:
            first.setdefault(template(own), (j, own))
    forms = defaultdict(list)
    for j, own in first.values():
        for turned in itertools.product([False, True], repeat=5):
            begins = [t and kind is None for t, (kind, _) in zip(turned, own)]
            if sum(begins) > 1 or any(t and kind in ("number", "unit") for t, (kind, _) in zip(turned, own)):
                continue
            if any(b and (w in d.NO_NAMES or regex.match(r"\p{N}", w)) for b, (_, w) in zip(begins, own)):
                continue
            form = [(("same" if k is None else None) if t else k, w) for t, (k, w) in zip(turned, own)]
            as_template = tuple("name" if k == "same" else k or w for k, w in form)
            if n_slots(form) <= 3:
                forms[as_template].append((any(turned), j, tuple((k, w) for k, w in form if k)))
    return {t: min(f, key=lambda x: x[:2])[1:] for t, f in forms.items()}, len(first)


def brute(text, forms, n_windows):
    words, places = marked(text), defaultdict(lambda: (set(), set()))
    for i in range(len(words) - 4):
        own = words[i : i + 5]
        if template(own) in forms:
            j, slots = forms[template(own)]
            js, pairs = places[i - j]
            js.add(j)
            pairs.update(zip(slots, [x for x in own if x[0]]))
    covered, run, other = set(), 0, False
    for js, pairs in places.values():
        if len({a for a, _ in pairs}) < len(pairs) or any(a[0] == "same" and a[1] != b[1] for a, b in pairs):
            continue
        covered |= js
        run = max(run, len(js))
        other |= any(a[0] != "same" and a != b for a, b in pairs)
    found = n_windows and (len(covered) / n_windows >= d.LEAST_COVERAGE or run >= d.LEAST_RUN)
    return (n_windows, len(covered), "other values" if other else "same") if found else None


def sentence(rng, n):
    def word():
        return rng.choice(NAMES) if rng.random() < 0.15 else rng.choice(["5", "12", "three", "twenty-one", "1,000", "3kg", "7 km"]) if rng.random() < 0.15 else rng.choice(LITERALS)

    return " ".join(word() for _ in range(n)) + rng.choice([".", "?", ""])


def variant(rng, text):
    """The text with values and names changed, sometimes not alike, or with some other words."""
    turns = {"5": "8", "12": "40", "three": "nine", "Peter": "Sven", "Maria": "Lee", "Kim": "Pat"}
    words = [turns.get(w, w) if rng.random() < 0.95 else w for w in text.split(" ")]
    for _ in range(rng.choice([0, 0, 1, 3])):
        words[rng.randrange(len(words))] = rng.choice([*LITERALS, "Road", "9"])
    if rng.random() < 0.3:
        words = [w.lower() for w in words]
    return rng.choice([" ", "\n", "  "]).join(words)


@pytest.mark.parametrize("seed, most_broadcast", [(1, 500_000), (2, 0)])
def test_all_windows_at_all_places(spark, frame, seed, most_broadcast):
    rng = random.Random(seed)
    items = [(k, sentence(rng, rng.randint(3, 30))) for k in range(25)] + [(90, None), (91, ""), (92, "Peter 5 Maria 6 Kim 7 Olga")]
    rows = [(1000, None, "a"), (1001, "", "a")]
    for k in range(160):
        _, item = items[rng.randrange(25)]
        body = item if rng.random() < 0.2 else variant(rng, item)
        if rng.random() < 0.2:
            body = " ".join(body.split(" ")[: rng.randint(5, 20)])
        rows.append((k, f"{sentence(rng, rng.randint(0, 30))}\n{body} {sentence(rng, rng.randint(0, 30))}", "a"))
    forms = {k: item_forms(t) for k, t in items}
    expected = {(doc, k): brute(text, *own) for doc, text, _ in rows for k, own in forms.items()}
    expected = {at: x for at, x in expected.items() if x}
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.contaminated(frame(rows), bench, most_broadcast=most_broadcast).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.kind) for r in found} == expected
    assert len({kind for _, _, kind in expected.values()}) == 2 and len(expected) > 60
