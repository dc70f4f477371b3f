"""``python -m quillsift``: see :mod:`quillsift.plans.run`."""

import sys

from quillsift.plans.run import main

sys.exit(min(main(), 1))
