from .plans.extract import main

main()
