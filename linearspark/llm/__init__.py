"""Operators of a training-data pipeline (licences, quality, extraction,
packing, near-duplicates, lines, chat, toxicity, decontamination, LM scores).

Nothing outside this subpackage imports it; the queries are in ``queries``.
"""
