def fine():
    return 1

def broken(:
    pass
