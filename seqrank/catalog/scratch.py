"""Folders for what queries write."""

from __future__ import annotations

import uuid

from seqrank.session import ensure_checkpoint_dir


def scratch(v) -> str:
    ensure_checkpoint_dir(v.spark)
    return f"{v.spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"
