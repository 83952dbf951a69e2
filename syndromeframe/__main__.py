from .study import main

main()
