from cleanloom.cli import main

raise SystemExit(main())
