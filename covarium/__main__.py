import sys

from covarium.plans.stages import main

sys.exit(main())
