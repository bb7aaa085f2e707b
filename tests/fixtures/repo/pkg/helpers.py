LIMIT = 10


def report(value):
    for i in range(LIMIT):
        while value > i:
            value -= 1
    return format_value(value)


def format_value(value):
    return str(value)
