def hidden(): pass
