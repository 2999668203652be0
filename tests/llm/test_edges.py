"""Every query on empty tables and on rows of nulls, empty, long, repeated and tied values."""

import datetime

import pytest

from tests.tables import write
from tonewright.llm import catalog

LONG = "Sound System " * 5000
NAMES = [None, "", " ", "?", "😀", "The Bromi Band", "The Bromi Band", "THE BROMI BAND!", "Bromi Band, The", LONG, "Ã©", "а", "‌", "—"]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    metadata = [{"file_id": None if i == 0 else i // 2, "tag_artist": a, "tag_album": NAMES[(i * 3) % len(NAMES)], "tag_title": NAMES[(i * 5) % len(NAMES)], "tag_albumartist": NAMES[-i], "raw_tags_json": r} for i, a in enumerate(NAMES) for r in (None, "", "{", '{"artist": "Bj\\u00c3\\u00b6rn"}', '{"title": "A"}')]
    files = [{"file_id": i, "src_path": p, "status": "meta_ok", "last_update_at": datetime.datetime(2024, 1, 1)} for i, p in enumerate([None, "", "/a/b.mp3", "x", "/src/" + LONG + "/y.mp3", "/src/f.mp3"])]
    clusters = [{"cluster_key": k} for k in (None, "", "|", "a|b|c", "a|b|live|3|disc1|track2", "B|A|LIVE|3|disc1|track2", LONG)]
    members = [{"cluster_key": k, "file_id": f, "quality_score": q, "preferred": p} for k in (None, "", "k") for f in (None, 1, 2, 2, 99) for q, p in ((None, None), (1.0, True), (float("nan"), False))]
    cache = [{"search_name": s, "canonical_name": c, "aliases": a} for s, c in ((None, None), ("", ""), ("bromi band", "The Bromi Band"), (LONG, LONG)) for a in (None, [], ["", None, "Bromy Band"])]
    documents = [{"doc_id": i, "text": t, "lang": lang} for i, (t, lang) in enumerate([(None, None), ("", ""), ("   \n\n ", "en"), ("One. Two.", "EN"), ("x" * 200_000, "und"), ("Word. " * 20_000, None), ("", "en"), ("。。。", "ja")])] + [{"doc_id": None, "text": "A b."}, {"doc_id": 3, "text": "One. Two."}]
    items = [{"item_id": i, "text": t} for i, t in enumerate([None, "", "One.", "Word. " * 30])] + [{"item_id": None, "text": "x"}]
    return write(spark, tmp_path_factory.mktemp("odd"), metadata=metadata, files=files, clusters=clusters, cluster_members=members, musicbrainz_cache=cache, documents=documents, eval_items=items)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, empty, name):
    assert catalog.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_odd_rows(spark, odd, name):
    catalog.queries()[name](spark, odd).collect()
