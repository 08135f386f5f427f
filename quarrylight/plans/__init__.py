"""quarrylight.plans"""
