from tamarack.cli import main

main()
