"""Limits and fixed values of the engine, named once."""

from __future__ import annotations

from dataclasses import dataclass

# Attribute bits of file metadata.
REPARSE, OFFLINE, RECALL_ON_OPEN, RECALL_ON_DATA = 0x400, 0x1000, 0x40000, 0x400000
OFFLINE_MASK = OFFLINE | RECALL_ON_OPEN | RECALL_ON_DATA
NO_CONTENT_MASK = OFFLINE_MASK | REPARSE

# Reason bits of change-journal records.
DATA_OVERWRITE, DATA_EXTEND, DATA_TRUNCATION, BASIC_INFO, CLOSE = 0x1, 0x2, 0x4, 0x8000, 0x80000000
CREATE, DELETE, RENAME_OLD, RENAME_NEW, HARD_LINK, REPARSE_CHANGE, STREAM_CHANGE = 0x100, 0x200, 0x1000, 0x2000, 0x10000, 0x100000, 0x200000
STRUCTURAL_MASK = CREATE | DELETE | RENAME_OLD | RENAME_NEW | HARD_LINK | REPARSE_CHANGE | STREAM_CHANGE

# Fixed value: the attribute bit of system files.
SYSTEM = 0x4

#: What files without an extension are listed under.
NO_EXTENSION = "sem extensão"


@dataclass(frozen=True)
class Limits:
    """Sizes of reports, budgets and batches."""

    top: int = 300
    top_types: int = 30
    matches: int = 500
    scopes: int = 100
    page: int = 100
    page_most: int = 200
    edge_bytes: int = 16 * 1024
    hash_chunk: int = 4 << 20
    identity_group: int = 1024
    pattern_bytes: int = 4096
    standard_budget: int = 8 << 30
    deep_budget: int = 64 << 30
    index_batch: int = 1024
    journal_events: int = 100_000
    bulk_records: int = 2_000_000
    tree_depth: int = 128
    allocation_targets: int = 300
    audit_rows: int = 5000
    quarantine_rows: int = 500
    scan_errors: int = 12
    compare_errors: int = 10
    cards: int = 6
    chart_types: int = 7
    listed_matches: int = 50
    grant_seconds: int = 300
    retain_seconds: int = 6 * 3600


LIMITS = Limits()
BUDGETS = {None: LIMITS.standard_budget, "standard": LIMITS.standard_budget, "deep": LIMITS.deep_budget, "unlimited": None}
