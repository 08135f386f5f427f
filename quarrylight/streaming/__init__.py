"""quarrylight.streaming"""
