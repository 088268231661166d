import sys

from terrasift.cli import main

sys.exit(main())
