from depweave.llm import registry


def test_sql_is_text_and_every_operator_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES) and all(isinstance(s, str) for s in registry.ORACLES.values())
    assert all(callable(q) for q in registry.QUERIES.values())
