import sys

from recframe.cli import main

sys.exit(main())
