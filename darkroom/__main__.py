import sys

from darkroom.cli import main

sys.exit(main())
