"""python -m factloom"""

import sys

from factloom.cli import main

sys.exit(main())
