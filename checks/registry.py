"""All registered queries: name → (function, SQL or None)."""

from checks import q_blocks, q_files, q_history, q_rules, q_streams, q_text

ALL = {}
for module in (q_files, q_rules, q_blocks, q_history, q_text, q_streams):
    overlap = set(ALL) & set(module.QUERIES)
    assert not overlap, overlap
    ALL.update(module.QUERIES)
