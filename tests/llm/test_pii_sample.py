"""The tagger's training sample counts distinct windows, however often a text is copied."""

from glyphmill.llm import pii
from tests.llm import cases


def test_copies_do_not_change_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii.Tagger, "train", lambda self, x, y: seen.append((x.tolist(), y.tolist())))
    texts = [f"write to {'u' * (i % 9 + 1)}{i}@host{i}.org, {i} days later" for i in range(60)]
    texts += [f"{'of ' * (i % 7)}the {i} items" for i in range(60)]
    one = [(i, t, "en", "s") for i, t in enumerate(texts)]
    many = one + [(1000 + 200 * n + i, t, "en", "s") for n, t in enumerate(texts) for i in range(40 * (n % 3 == 0))]
    for rows in (one, many):
        pii.fit(cases.table(spark, rows), windows=32)
    (x, y), copied = seen
    assert len(x) == 32 and len({(tuple(a), tuple(b)) for a, b in zip(x, y, strict=True)}) > 16
    assert (x, y) == copied
