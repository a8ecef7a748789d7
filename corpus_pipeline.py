"""The corpus pipeline's driver contract: STAGES, ORACLE_SQL and run()."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vicinal.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: E402

__all__ = ["ORACLE_SQL", "STAGES", "run"]
