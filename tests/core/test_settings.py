import pytest

from mnestra import settings


def test_layers(tmp_path):
    file = tmp_path / "s.toml"
    file.write_text("recall_limit = 5\nchunk_chars = 100\n")
    made = settings.load(str(file), {"MNESTRA_CHUNK_CHARS": "200", "OTHER": "x"}, "coding")
    assert (made.recall_limit, made.chunk_chars, made.recall_max_tokens, made.batch_facts) == (5, 200, 2048, 8)
    for environment in ({"MNESTRA_NO_SUCH": "1"}, {"MNESTRA_RECALL_LIMIT": "many"}, {"MNESTRA_RECALL_BUDGET": "huge"}):
        with pytest.raises(ValueError):
            settings.load(None, environment)
    with pytest.raises(ValueError):
        settings.load(None, {}, "nobody")
