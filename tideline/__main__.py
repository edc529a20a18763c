import sys

from tideline.cli import main

sys.exit(main())
