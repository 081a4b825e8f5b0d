import pytest

from cellweave.config import Settings, positive, settings


def test_override_and_reset():
    before = settings.block_rows
    with settings.override(block_rows=8, max_workers=3):
        assert settings.block_rows == 8 and settings.max_workers == 3
    assert settings.block_rows == before and settings.max_workers is None
    settings.large_query_threshold = 5
    settings.reset("large_query_threshold")
    assert settings.large_query_threshold == 50_000


def test_checks():
    with pytest.raises(TypeError):
        settings.block_rows = "8"
    with pytest.raises(TypeError):
        settings.block_rows = True
    with pytest.raises(ValueError):
        settings.block_rows = 0
    with pytest.warns(UserWarning), settings.override(block_rows=12):
        pass
    with pytest.warns(UserWarning), settings.override(max_rows_per_chunk=200_000):
        pass
    with pytest.raises(AttributeError):
        settings.nothing = 1
    assert "block_rows" in settings.describe() and "block_rows" in dir(settings)


def test_environment_is_checked(monkeypatch):
    monkeypatch.setenv("CELLWEAVE_SPEED", "7")
    s = Settings()
    s.register("speed", 3, int, check=positive)
    assert s.speed == 7
    s.reset("speed")
    assert s.speed == 3
    monkeypatch.setenv("CELLWEAVE_BAD", "-1")
    with pytest.raises(ValueError):
        s.register("bad", 1, int, check=positive)
    s.deprecate("speed", "use another")
    with pytest.warns(FutureWarning, match="another"):
        assert s.speed == 3
    monkeypatch.setenv("CELLWEAVE_FLAG", "no")
    s.register("flag", True, bool)
    assert s.flag is False
