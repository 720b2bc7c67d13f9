"""Shared by the tests: where the small tables are."""

import os

DATA = os.environ.get("GRANARY_TESTDATA", "/root/testdata")
SF_TINY, SF_SMALL = f"{DATA}/sf0.001", f"{DATA}/sf0.01"
