"""python -m quern JOB ..."""

import sys

from quern.plans.jobs import main

sys.exit(main())
