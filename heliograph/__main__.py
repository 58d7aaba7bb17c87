import sys

from heliograph.cli import main

sys.exit(main())
