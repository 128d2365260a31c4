"""Tests of the fourth round's changes to the operators on text."""

from types import SimpleNamespace

import pytest

from lacuna.llm import pseudonyms


def _session(master, settings):
    conf = SimpleNamespace(get=settings.get, set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_without_a_key_draws_a_secret_one_for_the_session():
    first, second = _session("spark://host:7077", {}), _session("spark://host:7077", {})
    with pytest.warns(UserWarning, match=pseudonyms.KEY_SETTING):
        key = pseudonyms.session_key(first)
    assert len(key) == 64 and key != pseudonyms.TEST_KEY
    assert pseudonyms.session_key(first) == key
    with pytest.warns(UserWarning):
        assert pseudonyms.session_key(second) != key
    assert pseudonyms.session_key(_session("spark://host:7077", {pseudonyms.KEY_SETTING: "given"})) == "given"
    assert pseudonyms.session_key(_session("local[2]", {})) == pseudonyms.TEST_KEY
