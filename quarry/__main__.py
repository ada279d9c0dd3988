from quarry.api import main

raise SystemExit(main())
