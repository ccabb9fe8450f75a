"""Settings from the environment and from files."""

import pytest

from paperlake.settings import load

GIVEN = {"DEBUG": "true", "MONGODB_SERVER": "db", "MONGODB_PORT": "27017", "MONGODB_DATABASE": "papers"}


def test_environment_goes_before_files(tmp_path):
    first, second = tmp_path / "a.env", tmp_path / "b.env"
    first.write_text("# comment\nMONGODB_SERVER=one\nPROJECT_NAME='Named'\nexport DEBUG=off\n")
    second.write_text('MONGODB_SERVER="two"\n\nOTHER=1\n')
    got = load({"MONGODB_PORT": "1", "MONGODB_DATABASE": "d", "MONGODB_SERVER": ""}, (str(first), str(second), str(tmp_path / "none")))
    assert (got.MONGODB_SERVER, got.PROJECT_NAME, got.DEBUG, got.MONGODB_PORT, got.API_V1_STR) == ("two", "Named", False, 1, "/api/v1")


def test_addresses():
    plain = load(GIVEN, ())
    assert plain.store_uri == plain.shown_uri == "mongodb://db:27017/papers"
    full = load({**GIVEN, "MONGODB_ROOT_USERNAME": "me", "MONGODB_ROOT_PASSWORD": "p@ss"}, ())
    assert full.store_uri == "mongodb://me:p%40ss@db:27017/papers?authSource=admin"
    assert full.shown_uri == "mongodb://***:***@db:27017/papers?authSource=admin"


def test_what_is_not_given():
    with pytest.raises(ValueError, match="MONGODB_PORT"):
        load({k: v for k, v in GIVEN.items() if k != "MONGODB_PORT"}, ())
    with pytest.raises(ValueError):
        load({**GIVEN, "DEBUG": "perhaps"}, ())
    with pytest.raises(ValueError):
        load({**GIVEN, "MONGODB_PORT": "x"}, ())
